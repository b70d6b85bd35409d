import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from vacantia.llm import warc


def records(n):
    return [warc.record("response", f"urn:page:{k}", f"http://x/{k}", "2024-01-01T00:00:00Z", f"<html>page {k} {'text ' * (k % 50)}</html>".encode()) for k in range(n)]


def test_round_trip_with_dictionary():
    made = warc.archive(records(600), dictionary=2048)
    assert struct.unpack_from("<I", made)[0] == warc.SKIPPABLE
    got = [warc.parse(r) for r in warc._frames(made)]
    assert [g["record_id"] for g in got] == [f"urn:page:{k}" for k in range(600)]
    assert got[7]["payload"].startswith(b"<html>page 7")
    # one frame a record: each frame decodes alone with the dictionary
    n = struct.unpack_from("<I", made, 4)[0]
    d = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(made[8 : 8 + n]))
    first = zstandard.ZstdDecompressor(dict_data=d).decompressobj()
    assert first.decompress(made[8 + n :]) == records(600)[0]


def test_without_dictionary_and_plain_dictionary():
    few = warc.archive(records(2))
    assert len(list(warc._frames(few))) == 2
    d = zstandard.train_dictionary(1024, [r * 2 for r in records(300)], d=6, k=128)
    plain = struct.pack("<II", warc.SKIPPABLE, len(d.as_bytes())) + d.as_bytes() + zstandard.ZstdCompressor(dict_data=d).compress(records(1)[0])
    assert list(warc._frames(plain)) == records(1)
    assert list(warc._frames(b"")) == []


def test_faults():
    r = records(1)[0]
    for bad in (r[:-1], r.replace(b"WARC/1.1", b"WORC/1.1"), r.replace(b"WARC-Date", b"WARC-Dote"), r.replace(b"page 0", b"page 1"), r.replace(b"Content-Length: ", b"Content-Length: 1", 1)):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
    made = warc.archive(records(3))
    for bad in (made[:-5], made + b"\x00garbage", struct.pack("<II", warc.SKIPPABLE, 100) + b"short"):
        with pytest.raises(warc.WarcError):
            list(warc._frames(bad))


def test_duplicates(spark):
    rows = [(5, "u5", "same"), (3, "u3", "same"), (9, "u9", "same"), (1, None, None), (2, "u2", ""), (4, "u 4", "other"), (4, "u 4", "other"), (None, "n", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_digest_extra", F.lit(1))
    got = {(r["record_id"], r["record_type"]): r for r in warc.read(warc.write(pages, archive_bytes=200)).collect()}
    assert got[("urn:page:3", "response")]["refers_to"] is None
    assert got[("urn:page:5", "revisit")]["refers_to"] == "urn:page:3" and got[("urn:page:5", "revisit")]["payload_bytes"] == 4
    assert got[("urn:page:9", "revisit")]["payload_digest"] == warc.digest(b"same")
    assert got[("urn:page:2", "revisit")]["refers_to"] == "urn:page:1" and got[("urn:page:2", "revisit")]["payload_bytes"] == 0
    assert got[("urn:page:none", "revisit")]["refers_to"] == "urn:page:3"
    assert warc.read(warc.write(pages)).count() == len(rows)
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_repeated_ids_and_null_ids(spark):
    rows = [(4, "u", "same"), (4, "u", "same"), (None, "v", "same"), (9, "w", "same"), (None, "x", "no id"), (None, "y", "no id"), (2, "z", None), (3, "z", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r["record_id"], r["record_type"], r["refers_to"]) for r in warc.read(warc.write(pages)).collect()]
    none = "urn:page:none"
    assert sorted(got, key=str) == sorted([("urn:page:4", "response", None), ("urn:page:4", "revisit", "urn:page:4"), (none, "revisit", "urn:page:4"), ("urn:page:9", "revisit", "urn:page:4"), (none, "response", None), (none, "response", None), ("urn:page:2", "response", None), ("urn:page:3", "revisit", "urn:page:2")], key=str)


def test_query_against_sql(spark):
    import duckdb

    from vacantia.llm import queries

    sf = "/root/testdata/sf0.01"
    got = queries.op2_warc_zstd(spark, sf).toPandas().sort_values("page_id").reset_index(drop=True)
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = duckdb.sql(queries.ORACLE["op2_warc_zstd"]).df().sort_values("page_id").reset_index(drop=True)[list(got.columns)]
    assert len(got) and (got.astype(str).replace("<NA>", "nan") == want.astype(str).replace("<NA>", "nan")).all().all()
