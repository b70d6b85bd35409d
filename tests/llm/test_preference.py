import duckdb
import pytest
from pyspark.sql import functions as F

from vacantia.llm import preference, queries

KIND = "pair_id long, position long, role string, text string"


def test_prefix_and_masks(spark):
    chosen = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "good"), (1, 2, "user", "more"), (1, 3, "assistant", "better"), (2, 0, "user", "a"), (3, 0, "user", "same"), (4, 0, "user", "alone"), (5, 0, None, None), (5, 1, "assistant", "é" * 50000)], KIND)
    rejected = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "good"), (1, 2, "user", "more"), (1, 3, "assistant", "bad"), (2, 0, "user", "b"), (2, 1, "assistant", "c"), (3, 0, "user", "same"), (5, 0, "user", "")], KIND)
    got = {r["pair_id"]: r for r in preference.formatted(preference.paired(chosen, rejected)).collect()}
    assert set(got) == {1, 2, 3, 5}
    one = got[1]
    assert one["prefix_turns"] == 3 and one["prompt"].count("<|im_start|>") == 3 and "good" in one["prompt"]
    begin, end = one["chosen_mask"][0]
    assert one["chosen_completion"][begin:end] == "better<|im_end|>"
    begin, end = one["rejected_mask"][0]
    assert one["rejected_completion"][begin:end] == "bad<|im_end|>"
    assert got[2]["prefix_turns"] == 0 and got[2]["prompt"] == "" and got[2]["chosen_mask"] == []
    assert got[3]["prefix_turns"] == 1 and got[3]["chosen_completion"] == got[3]["rejected_completion"] == ""
    begin, end = got[5]["chosen_mask"][0]
    assert got[5]["prefix_turns"] == 1 and got[5]["rejected_completion"] == "" and got[5]["chosen_completion"][begin:end] == "é" * 50000 + "<|im_end|>"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, 0, "user", "q1", "x"), (1, 1, "assistant", "a1", "x"), (1, 2, "user", "thanks", "x"), (5, 0, None, None, "x"), (5, 1, "assistant", "a5", "x"), (5, 1, "assistant", "a5", "x"), (7, 0, "user", "q7", "x"), (None, 0, "user", "lost", "x"), (1 << 60, None, "assistant", "a9", "x")]
    rows += [(100 + k, j, "user" if j % 2 == 0 else "assistant", f"t{k % 3}" if j == 3 else f"u{j}", None) for k in range(40) for j in range(4)]
    rows += [(200 + k, 1, "assistant", "the same answer", "x") for k in range(30)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string")


def brute(rows):
    import hashlib

    turns = {}
    for c, n, role, text, _ in rows:
        if c is not None:
            turns.setdefault(c, set()).add((n is not None, n or 0, role or "user", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    last = {c: max(k for k, t in enumerate(v) if t[0] == "assistant") for c, v in turns.items() if any(t[0] == "assistant" for t in v)}
    order = sorted(last, key=lambda c: (hashlib.md5(str(c).encode()).hexdigest(), c))
    out = {}
    for k, c in enumerate(order):
        own = turns[c][last[c]][1]
        for other in order[k + 1 :] + order[:k]:
            text = turns[other][last[other]][1]
            if text != own:
                out[c] = (last[c], f"<|im_start|>assistant\n{text}<|im_end|>\n", "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns[c][last[c] :]))
                break
    return out


@pytest.mark.parametrize("bucket", [preference.BUCKET, 3])
def test_swapped_answers_against_brute_force(spark, odd, monkeypatch, bucket):
    monkeypatch.setattr(preference, "BUCKET", bucket)
    got = {r["pair_id"]: (r["prefix_turns"], r["rejected_completion"], r["chosen_completion"]) for r in preference.formatted(preference.swapped_answers(odd)).collect()}
    assert got == brute([tuple(r) for r in odd.collect()]) and len(got) == 73
    assert all(a != b for _, a, b in got.values())


def test_no_other_answer_no_pair(spark, odd):
    for some in (odd.limit(0), odd.filter("conv_id BETWEEN 200 AND 300"), odd.filter("conv_id = 1"), odd.filter("role = 'user'")):
        assert preference.formatted(preference.swapped_answers(some)).count() == 0
    two = odd.filter("conv_id = 1 OR conv_id = 5").withColumnRenamed("text", "said")
    assert preference.formatted(preference.swapped_answers(two, text="said")).count() == 2


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_preference_pairs(spark, sf).toPandas().sort_values("conv_id").reset_index(drop=True)
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = duckdb.sql(queries.ORACLE["op5_preference_pairs"]).df().sort_values("conv_id").reset_index(drop=True)[list(got.columns)]
    assert len(got) and (got.astype(str) == want.astype(str)).all().all()
