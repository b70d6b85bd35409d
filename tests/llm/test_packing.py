import collections
import random
import zlib

import numpy as np
import pytest

from vacantia.llm import packing
from vacantia.llm.queries import tokenizer_path


def test_differencing_balances():
    r = random.Random(1)
    sizes = [r.randint(1, 400) for _ in range(300)]
    parts = packing.differencing(sizes, 20)
    assert sorted(i for p in parts for i in p) == list(range(300))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) <= 3
    # the textbook two-way case
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]
    assert packing.differencing([3], 2) == [[0], []]


@pytest.mark.parametrize("seed", range(3))
def test_groups_fill_windows(seed):
    r = random.Random(seed)
    runs = [(k, 0, r.randint(1, 2047) if seed else 1500) for k in range(384)]
    out = packing.pack_group(runs, 2048)
    assert all(sum(p[2] for p in w) <= 2048 for w in out)
    used = sum(r[2] for r in runs)
    assert sum(p[2] for w in out for p in w) == used and used / (2048 * len(out)) > 0.97


def test_little_groups_are_powers_of_two():
    out = packing.pack_group([(0, 0, 700), (1, 0, 600)], 2048)
    assert sorted(sum(p[2] for p in w) for w in out) == [4, 16, 256, 1024]


def test_pieces_tile_documents_and_sequences(docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    slow = Tokenizer.from_file(path)
    rows = packing.packed(docs.drop("n_words"), path, with_ids=True).collect()
    want = collections.Counter((r["doc_id"], zlib.crc32(np.array([*slow.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in docs.collect())
    seqs = collections.defaultdict(list)
    by_doc = collections.defaultdict(list)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[(r["doc_id"], r["doc_tokens"])].append(r)
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    got = collections.Counter()
    for (doc, n), parts in by_doc.items():
        parts.sort(key=lambda r: (r["start"], r["ids_crc32"]))
        times = sum(p["length"] for p in parts) // n
        assert sum(p["length"] for p in parts) == n * times
        ids = [i for p in {p["start"]: p for p in parts}.values() for i in p["ids"]]
        got[(doc, zlib.crc32(np.array(ids, "<u4").tobytes()))] += times
    assert got == want
    assert packing.packed(empty, path).count() == 0


def test_engines_agree():
    from tokenizers import Tokenizer

    slow, fast = Tokenizer.from_file(tokenizer_path()), packing.encoder(tokenizer_path())
    r = random.Random(5)
    pool = "abc ABC  \n\t'sé東,.!?#123 <|endoftext|> ​🙂"
    for _ in range(300):
        t = "".join(r.choices(pool, k=r.randint(1, 60)))
        assert fast(t).tolist() == slow.encode(t, add_special_tokens=False).ids
