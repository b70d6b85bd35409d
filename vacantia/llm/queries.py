"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, cosine_dedup, htmlmodel, jpeg, labelled_pages, licenses, lmscore, mixing, packing, preference, quality_rules, repair, simhash, warc
from .common import stored, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary files are installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a progressive JPEG, decoded again."""
    out = jpeg.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: [F.length(c).cast("long").alias(f"{c}_bytes"), F.sha2(c, 256).alias(f"{c}_sha256")]
    return out.select("doc_id", "n_bytes", *digest("payload"), jpeg.tail_crc("payload").alias("tail_crc32"), *digest("media"), "feature")


def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records in dictionary-compressed archives, and read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = stored(warc.write(pages), "warc-archives")
    out = warc.read(archives, payload=False)
    number = lambda c: F.nullif(F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1), F.lit("")).cast("long")
    return out.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op3_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document; documents labelled good are the target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = lmscore.with_good(docs, table(spark, sf_dir, "labels"))
    return lmscore.scored(docs, F.col("is_good")).drop("is_good")


def op4_entropy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that a mix by source weights 1, 2, 3 takes."""
    docs = table(spark, sf_dir, "documents")
    # Only counts are returned, so texts are read once: for their words, and a hash that tells rows apart.
    sizes = stored(docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")), "mix-documents")
    by = {"size": "size", "identity": ("doc_id", "source", "text_hash")}
    out = mixing.copies(sizes, mixing.fit(sizes, **by), **by)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_rate").alias("rate"), F.col("_copies").alias("copies"))


def op5_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with an answer, against its twin with another answer."""
    out = preference.formatted(preference.swapped_answers(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return out.select(F.col("pair_id").alias("conv_id"), "prefix_turns", "prompt", "chosen_completion", spans("chosen_mask").alias("chosen_spans"), "rejected_completion", spans("rejected_mask").alias("rejected_spans"))


def op6_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics and the verdict of a decision list learned from `labels`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    out = quality_rules.judged(docs, rules, prefix="q_")
    return out.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"))


def op8_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article's text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = htmlmodel.main_text(pages, labelled_pages.trained())
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses stated in every document."""
    out = licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "licenses", "n_blocks", F.array_max("reductions").alias("best_reduction"), F.array_join("differences", ";").alias("differences"))


def op11_kd_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all embeddings, codebooks of two rounds of integer k-means."""
    out = codes.encoded(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding at a cosine of 0.9."""
    return cosine_dedup.classes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after planted damage."""
    return repair.repaired(repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_progressive_jpeg": op1_progressive_jpeg,
    "op2_warc_zstd": op2_warc_zstd,
    "op3_cross_entropy": op3_cross_entropy,
    "op4_entropy_balance": op4_entropy_balance,
    "op5_preference_pairs": op5_preference_pairs,
    "op6_karmarkar_karp": op6_karmarkar_karp,
    "op7_decision_list": op7_decision_list,
    "op8_tree_extraction": op8_tree_extraction,
    "op9_simhash_anchors": op9_simhash_anchors,
    "op10_license_scan": op10_license_scan,
    "op11_kd_tree_codes": op11_kd_tree_codes,
    "op12_int8_tiles": op12_int8_tiles,
    "op13_turn_repair": op13_turn_repair,
}

#: One round of integer k-means: each part goes to its nearest entry, each entry becomes its parts' floored mean.
_ROUND = """
        a{0} AS MATERIALIZED (SELECT v.vec_id, v.label, v.p, v.x, min({{'d': list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': b.e}}) AS m FROM v JOIN b{0} b ON b.p = v.p GROUP BY ALL),
        s{0} AS (SELECT p, m.e AS e, i, floor(sum(x[i]) / count(*))::BIGINT AS y FROM a{0}, range(1, 1 + (SELECT any_value(len(x)) FROM v)) AS t(i) GROUP BY ALL),
        b{1} AS MATERIALIZED (SELECT p, e, coalesce(n.x, o.x) AS x FROM b{0} o LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS x FROM s{0} GROUP BY ALL) n USING (p, e)),
"""

#: DuckDB SQL where SQL can express the operator. The rendering of turns, and the alphabet of base32, are fixed values.
ORACLE: dict[str, str] = {
    "op2_warc_zstd": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        h AS (SELECT page_id, strlen(body) AS n, sha1(body) AS x FROM p),
        d AS (SELECT page_id, n, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1) FOR i IN range(0, 32)], '') AS payload_digest FROM h),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS k FROM d)
        SELECT page_id, n::BIGINT AS payload_bytes, payload_digest, CASE WHEN k = 1 OR least IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN least END AS refers_to FROM f
    """,
    "op5_preference_pairs": """
        WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS made FROM t),
        l AS (SELECT conv_id, max(k) AS last FROM n WHERE role = 'assistant' GROUP BY conv_id),
        a AS (SELECT n.conv_id, l.last, n.text AS answer, md5(n.conv_id::VARCHAR) AS place FROM n JOIN l ON n.conv_id = l.conv_id AND n.k = l.last),
        r AS (SELECT *, CASE WHEN answer = lag(answer) OVER (ORDER BY place, conv_id) THEN 0 ELSE 1 END AS fresh FROM a),
        s AS (SELECT *, sum(fresh) OVER (ORDER BY place, conv_id) AS run FROM r),
        f AS (SELECT run, answer FROM s WHERE fresh = 1),
        e AS (SELECT max(run) AS most FROM s),
        w AS (SELECT s.conv_id, s.last, CASE WHEN s.run < most THEN (SELECT answer FROM f WHERE f.run = s.run + 1) WHEN s.answer <> (SELECT answer FROM f WHERE f.run = 1) THEN (SELECT answer FROM f WHERE f.run = 1) ELSE (SELECT answer FROM f WHERE f.run = 2) END AS other FROM s, e),
        v AS (SELECT n.*, w.last, coalesce(sum(length(made)) OVER (PARTITION BY n.conv_id, k >= last ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, w.other FROM n JOIN w ON n.conv_id = w.conv_id WHERE w.other IS NOT NULL)
        SELECT conv_id, last::BIGINT AS prefix_turns, coalesce(string_agg(made, '' ORDER BY k) FILTER (k < last), '') AS prompt,
            string_agg(made, '' ORDER BY k) FILTER (k >= last) AS chosen_completion,
            string_agg((pos + 13 + length(role))::BIGINT || '-' || (pos + length(made) - 1)::BIGINT, ',' ORDER BY k) FILTER (k >= last AND role = 'assistant') AS chosen_spans,
            '<|im_start|>assistant' || chr(10) || any_value(other) || '<|im_end|>' || chr(10) AS rejected_completion,
            '22-' || (22 + length(any_value(other)) + 10) AS rejected_spans
        FROM v GROUP BY conv_id, last
    """,
    "op11_kd_tree_codes": """
        WITH k AS (SELECT *, len(embedding) // 16 AS w FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % 16 = 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        f AS (SELECT * FROM k WHERE w = (SELECT w FROM k GROUP BY w ORDER BY count(*) DESC, w DESC LIMIT 1)),
        v AS MATERIALIZED (SELECT vec_id, label, p, list_transform(embedding[p * w + 1 : p * w + w], lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM f, range(16) AS t(p)),
        b0 AS MATERIALIZED (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1)::INT AS e, x FROM v QUALIFY e < 64),
    """ + _ROUND.format(0, 1) + _ROUND.format(1, 2) + """
        c AS (SELECT vec_id, label, p, min({'d': list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': b.e}) AS m FROM v JOIN b2 b USING (p) GROUP BY ALL),
        r AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM c GROUP BY ALL)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM r
    """,
    "op12_int8_tiles": """
        WITH RECURSIVE k AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
        l AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM k a JOIN k b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x)) / sqrt(list_dot_product(b.x, b.x)) >= 0.9),
        r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
        n AS (SELECT u, count(*) AS n FROM l GROUP BY u),
        c AS (SELECT u, min(v) AS v FROM r GROUP BY u)
        SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.v, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.v, vec_id)) AS kept FROM embeddings e LEFT JOIN n ON n.u = e.vec_id LEFT JOIN c ON c.u = e.vec_id
    """,
    "op13_turn_repair": """
        WITH RECURSIVE x AS (SELECT list(list_reduce([i::UBIGINT] || range(8)::UBIGINT[], lambda a, b: xor(a >> 1, (a & 1) * 3988292384::UBIGINT)) ORDER BY i) AS tab FROM range(256) t(i)),
        h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS z FROM conversations),
        g AS (SELECT h.*, xor(list_reduce([4294967295::UBIGINT] || list_transform(z, lambda c: ascii(c)::UBIGINT), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 20 AS f FROM h, x),
        d AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM g, range(2) t(i) WHERE f <> 0 AND (i = 0 OR f = 3)),
        b AS (SELECT *, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM d),
        o AS (SELECT *, row_number() OVER w - 1 AS k, lag(left(role, 1)) OVER w || left(role, 1) AS pair FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)),
        t AS MATERIALIZED (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM o),
        ins(q, i, r, said) AS (VALUES (0, 0, 0, ''), (0, 1, 2, chr(10) || 'user:'), (0, 2, 3, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 0, 1, ''), (1, 1, 2, chr(10) || 'user:'), (1, 2, 3, chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 0, 2, ''), (2, 1, 3, chr(10) || 'assistant:'), (3, 0, 3, ''), (3, 1, 2, chr(10) || 'user:')),
        ed(q, kind, initial, role, r, cost) AS (VALUES (0, 'K', 's', NULL, 1, 0), (0, 'K', 'u', NULL, 2, 0), (1, 'K', 'u', NULL, 2, 0), (2, 'K', 'a', NULL, 3, 0), (3, 'K', 'u', NULL, 2, 0), (0, 'R', NULL, 'user', 2, 1), (1, 'R', NULL, 'user', 2, 1), (2, 'R', NULL, 'assistant', 3, 1), (3, 'R', NULL, 'user', 2, 1), (0, 'D', NULL, NULL, 0, 2), (1, 'D', NULL, NULL, 1, 2), (2, 'D', NULL, NULL, 2, 2), (3, 'D', NULL, NULL, 3, 2)),
        ids AS (SELECT DISTINCT conv_id AS c FROM conversations),
        walk(c, k, q, cost, audit, said) AS (
            SELECT c, 0::BIGINT, 0, 0, '', '' FROM ids
            UNION ALL
            SELECT c, k, q, s.cost, s.audit, s.said FROM (
                SELECT w.c, w.k + 1 AS k, e.r AS q, min({'cost': w.cost + 5 * i.i + e.cost + CASE WHEN t.fault = 'truncated' AND e.kind <> 'D' THEN 5 ELSE 0 END, 'audit': w.audit || repeat('I', i.i) || e.kind, 'said': w.said || i.said || CASE WHEN e.kind = 'D' THEN '' ELSE chr(10) || coalesce(e.role, t.role) || ':' || t.text END}) AS s
                FROM walk w JOIN t ON t.conv_id IS NOT DISTINCT FROM w.c AND t.k = w.k JOIN ins i ON i.q = w.q JOIN ed e ON e.q = i.r
                WHERE (e.initial IS NULL OR e.initial = left(t.role, 1)) AND (e.kind = 'D' OR coalesce(t.fault, '') NOT IN ('blank', 'duplicate'))
                GROUP BY w.c, w.k, e.r)),
        n AS (SELECT ids.c, count(t.k) AS rows_, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM ids LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM ids.c GROUP BY ids.c),
        z AS (SELECT w.c, min({'cost': w.cost + 5 * i.i, 'audit': w.audit || repeat('I', i.i), 'said': w.said || i.said}) AS s FROM walk w JOIN n ON n.c IS NOT DISTINCT FROM w.c AND n.rows_ = w.k JOIN ins i ON i.q = w.q WHERE i.r IN (0, 3) GROUP BY w.c)
        SELECT n.c AS conv_id, gaps, blank, duplicate, truncated, illegal, z.s.cost::BIGINT AS cost, z.s.audit AS audit, sha256(substr(z.s.said, 2)) AS repaired_sha256 FROM n JOIN z ON z.c IS NOT DISTINCT FROM n.c
    """,
}
