"""Packing token runs into windows by Karmarkar-Karp multiway differencing.

Documents are tokenised and cut into runs; whole windows need no packing. The
rest is packed group by group, within a task, so nothing is shuffled: every run
starts as a partial partition of its own, and the two partial partitions with the
largest imbalance are merged, the heavy parts of one with the light parts of the
other, until one is left, whose windows are nearly equal. If a window is above
capacity, the window count rises; if that alone would leave too much padding, runs
are cut shorter and the group is packed again.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import tune_arrow

#: The published pre-tokenisation pattern of the byte-level BPE with 50k merges (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, object] = {}


def encoder(path: str):
    """A function from a text to its ids (uint32) under a tokenizers file.

    The file's own library is the reference. Byte-level BPE files with the pattern
    above are run by tiktoken's engine, whose ids are the same and come five times
    sooner; that is verified on a probe text, and any text it fails on goes to the
    reference."""
    if path in _encoders:
        return _encoders[path]
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)

    def plain(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    encode = plain
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer"):
        import tiktoken

        # The byte alphabet: printable characters stand for themselves, other bytes for characters from U+0100 on.
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        probe = "Probe: l'été, don't\n\n  stop 1234  <|endoftext|> naïve 東京 \t end. "

        def quick(text: str) -> np.ndarray:
            try:
                return fast.encode_to_numpy(text, allowed_special="all")
            except BaseException as e:  # the engine's panics are not Exceptions
                if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                    raise
                return plain(text)

        if np.array_equal(quick(probe), plain(probe)):
            encode = quick
    _encoders[path] = encode
    return encode


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The items of k windows of nearly equal sums (some may be empty)."""

    def spread(parts: list) -> int:
        return parts[0][0] - (parts[-1][0] if len(parts) == k else 0)

    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s if k > 1 else 0, i, [(s, i, i)]))
    heapq.heapify(heap)
    at = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        # Parts are in descending order, zeros left out: the smallest of a meet the largest of b.
        alone_a, alone_b = max(0, k - len(b)), max(0, k - len(a))
        both = [(x[0] + y[0], min(x[1], y[1]), (x[2], y[2])) for x, y in zip(a[alone_a:], reversed(b[alone_b:]), strict=False)]
        parts = a[:alone_a] + b[:alone_b] + both
        parts.sort(key=lambda p: (-p[0], p[1]))
        heapq.heappush(heap, (-spread(parts), at, parts))
        at += 1
    out = []
    for _, _, tree in heap[0][2] if heap else []:
        items, stack = [], [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack += t
            else:
                items.append(t)
        out.append(sorted(items))
    return out + [[] for _ in range(k - len(out))]


def split(run: tuple[int, int, int], most: int) -> list[tuple[int, int, int]]:
    """(document, start, length) in runs of `most` ids and what is left.

    What is left differs from run to run, and differencing evens windows out by such
    differences; equal parts would leave it nothing to work with."""
    doc, start, length = run
    return [(doc, start + a, min(most, length - a)) for a in range(0, length, most)]


def pack_group(runs: list[tuple[int, int, int]], window: int, slack: float = 0.01) -> list[list[tuple[int, int, int]]]:
    """Windows of at most `window` ids that hold every run once, cut where need be."""
    total = sum(r[2] for r in runs)
    if total < window:  # one window is not full: powers of two need no padding
        out, left = [], list(runs)
        for b in reversed(range(total.bit_length())):
            if total >> b & 1:
                room, part = 1 << b, []
                while room:
                    doc, start, length = left.pop(0)
                    part.append((doc, start, min(room, length)))
                    if length > room:
                        left.insert(0, (doc, start + room, length - room))
                    room -= part[-1][2]
                out.append(part)
        return out
    least, most = -(-total // window), window
    while True:
        pieces = [p for r in runs for p in (split(r, most) if r[2] > most else [r])]
        k = least
        while True:
            parts = differencing([p[2] for p in pieces], k)
            over = max(sum(pieces[i][2] for i in part) for part in parts)
            if over <= window:
                return [[pieces[i] for i in part] for part in parts if part]
            k += max(1, k // 100)
            if most > window // 16 and k > least * (1 + slack) + 1:
                break
        most //= 2


def packed(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", window: int = 2048, end_id: int = 1, group: int = 384, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document's ids are those of the tokenizer file and then end_id; a null or empty
    text has end_id alone. Pieces tile each document and each sequence; repeated rows
    are packed as often as they stand; a null doc_id stays null; an empty table gives
    no rows; other columns are not read. `group` runs are packed at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        sequence = 0
        ids: list[np.ndarray] = []
        names: list = []
        runs: list[tuple[int, int, int]] = []
        rows: list[tuple] = []

        def put(pieces: list[tuple[int, int, int]]) -> None:
            nonlocal sequence
            at = 0
            for doc, start, length in pieces:
                own = ids[doc][start : start + length]
                rows.append((names[doc], start, length, zlib.crc32(own.astype("<u4").tobytes()), len(ids[doc]), part << 40 | sequence, at, own if with_ids else None))
                at += length
            sequence += 1

        def flush() -> pa.RecordBatch:
            for w in pack_group(runs, window) if runs else []:
                put(w)
            cols = list(zip(*rows, strict=True)) or [()] * 8
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            if with_ids:
                arrays.append(pa.array(cols[7], pa.list_(pa.int32())))
            for x in (ids, names, runs, rows):
                x.clear()
            return pa.RecordBatch.from_arrays(arrays, names=out_names)

        held = 0
        for b in batches:
            keys, texts = b.column(b.schema.get_field_index(doc_id)), b.column(b.schema.get_field_index(text))
            for key, t in zip(keys.to_pylist(), texts, strict=True):
                t = t.as_py() or ""
                own = np.append(encode(t) if t else np.zeros(0, np.uint32), np.uint32(end_id)).astype(np.uint32)
                ids.append(own)
                names.append(key)
                held += len(own)
                whole = len(own) // window * window
                for start in range(0, whole, window):
                    put([(len(ids) - 1, start, window)])
                if len(own) > whole:
                    runs.append((len(ids) - 1, whole, len(own) - whole))
                if len(runs) >= group or held > 1 << 22:
                    yield flush()
                    held = 0
        yield flush()

    out_names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    tune_arrow(docs.sparkSession)
    rows = docs.selectExpr(f"cast(`{doc_id}` as long) as `{doc_id}`", f"`{text}`")
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
