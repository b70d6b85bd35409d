"""Cheapest repairs against a search over all edits, slices against whole conversations, faults by hand."""

import hashlib
import itertools
import random
import re
import zlib

import pyarrow as pa
import pytest

from vacantia.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?\Z")
FILLS = ["", *(a for a in "ua"), *map("".join, itertools.product("ua", repeat=2))]


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip("\t\n\x0b\x0c\r ")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def by_search(rows):
    """(cost, audit, repaired) over every choice of edits and up to two insertions at each place."""
    best = []
    options = []
    for (role, text), fault in zip(rows, faults_of(rows), strict=True):
        fine = 5 * (fault == "truncated")
        own = [(2, "D", None)]
        if fault not in ("blank", "duplicate"):
            own += [(fine, "K", (role, text)), (1 + fine, "R", ("user", text)), (1 + fine, "R", ("assistant", text))]
        options.append(own)
    name = {"u": "user", "a": "assistant"}
    for picks in itertools.product(*options):
        for fills in itertools.product(FILLS, repeat=len(rows) + 1):
            made = [(name[c], "") for c in fills[0]]
            for (_, _, row), fill in zip(picks, fills[1:], strict=True):
                made += ([row] if row else []) + [(name[c], "") for c in fill]
            if all(r for r, _ in made) and LEGAL.match("".join(r[0] for r, _ in made)):
                audit = "I" * len(fills[0]) + "".join(k + "I" * len(f) for (_, k, _), f in zip(picks, fills[1:], strict=True))
                best.append((sum(c for c, _, _ in picks) + 5 * sum(map(len, fills)), audit, "\n".join(f"{r}:{t}" for r, t in made)))
    return min(best)


def as_batches(rows, size):
    kinds = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("gone", pa.bool_()), ("fault", pa.string())])
    t = pa.Table.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], kinds)
    return iter(t.to_batches(size))


def walked(rows, size=10_000):
    return [tuple(r.values()) for b in repair.walk(as_batches(rows, size)) for r in b.to_pylist()]


def some(n, seed):
    r = random.Random(seed)
    pick = lambda w: [(r.choice(["user", "assistant", "system", "user", "assistant", "tool", ""]), r.choice(["One.", "Two!", "three", " \n", "Four? ", "five"])) for _ in range(w)]
    return [pick(r.randint(1, 3)) for _ in range(n)]


def given(conversations):
    return [(c, k, role, text, False, fault) for c, rows in enumerate(conversations) for k, ((role, text), fault) in enumerate(zip(rows, faults_of(rows), strict=True))]


def test_as_search():
    conversations = some(24, 1)
    got = walked(given(conversations))
    assert len(got) == 24
    for out, rows in zip(got, conversations, strict=True):
        cost, audit, made = by_search(rows)
        assert (out[6], out[7], out[8]) == (cost, audit, hashlib.sha256(made.encode()).hexdigest()), rows
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(rows)]
        assert out[5] == sum(p not in ("su", "ua", "au") for p in pairs)
        assert [out[2], out[3], out[4]] == [faults_of(rows).count(k) for k in ("blank", "duplicate", "truncated")]


@pytest.mark.parametrize("size", [1, 7, 64])
def test_slices_join(monkeypatch, size):
    """However rows are cut, the result is that of whole conversations."""
    r = random.Random(size)
    conversations = [[(r.choice(["user", "assistant", "system"]), r.choice([f"Text {k}.", f"text {k}", "Same.", " "])) for k in range(r.choice([1, 3, 30, 90]))] for _ in range(8)]
    rows = given(conversations)
    rows.insert(0, (-1, 5, None, None, True, None))
    rows.append((99, 5, None, None, True, None))
    whole = walked(rows)
    monkeypatch.setattr(repair, "SLICE", size)
    assert walked(rows, 13) == whole
    nothing = hashlib.sha256(b"").hexdigest()
    assert whole[0] == (-1, 0, 0, 0, 0, 0, 0, "", nothing) and whole[-1][1:] == whole[0][1:]


def test_damage_and_nulls(spark):
    rows = [(c, t, ["system", "user", "assistant"][min(t, 1) + (t > 0) * (t % 2 == 0)], f"Turn {t}! Said. No?", "x") for c in range(12) for t in range(6)]
    rows += [(None, 1, "user", None, None), (7, None, None, "late", None), (40, 3, "user", "a.", None), (40, 9, "user", "a.", None), rows[5], (50, None, "user", "Hi.", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault string").repartition(3)
    want = {}
    for c, t, role, text, _ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = ("user" if kind == 4 else role), ("" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        want.setdefault(c, []).extend([(t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    got = {r.conv_id: r for r in repair.repaired(repair.damaged(df)).collect()}
    assert got.keys() == want.keys()
    for c, own in want.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        turns = {t for t, _, _ in own if t is not None}
        assert got[c].gaps == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        fault = faults_of([(r, t) for _, r, t in own])
        assert [got[c].blank, got[c].duplicate, got[c].truncated] == [fault.count(k) for k in ("blank", "duplicate", "truncated")]
        one = walked([(0, t, r, x, False, f) for (t, r, x), f in zip(own, fault, strict=True)]) if own else None
        assert one is None or (got[c].cost, got[c].audit, got[c].repaired_sha256) == one[0][6:]


def test_empty_and_very_long(spark):
    kinds = "conv_id long, turn long, role string, text string"
    assert repair.repaired(repair.damaged(spark.createDataFrame([], kinds))).collect() == []
    rows = [("c", k, "user" if k % 2 == 0 else "assistant", f"{k} " + "word " * 20_000 + ".") for k in range(40)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").selectExpr("*", "false AS gone")
    (out,) = repair.repaired(df).collect()
    made = "\n".join(f"{r}:{t}" for _, _, r, t in rows)
    assert (out.cost, out.audit, out.repaired_sha256) == (0, "K" * 40, hashlib.sha256(made.encode()).hexdigest())
