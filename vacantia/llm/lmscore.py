"""Cross-entropy difference: documents scored by two n-gram models.

A target model (of chosen documents) and a background model are matched: one
vocabulary, the same bigram form, the same smoothing. The score of a document is the
mean over its tokens of target loss less background loss, so low scores read like
the target. Both models hold every word and every bigram of their documents, but
those of the document that is being scored: a document is never judged by itself,
while a second copy of it is.

Documents are packed into blocks of bounded text. Each block sends its distinct keys
(hashes of words and bigrams) with their counts to the part of the key space that
sums them; a part answers with the sums in the order of the block's own sorted keys,
so no key travels back and no count is broadcast or collected. A key costs one entry
a block however frequent it is, so no word or bigram is hot. Beyond 2 GB of text, keys
reach their part through relays, each of which adds up what some 256 blocks sent, so
that blobs grow with the input times the levels of relays, not with its square.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import stored, tune_arrow
from .textkernel import Words, mix, runs, slices

#: Weight of the unigrams in a bigram's estimate, in tokens; and of every word in a unigram's.
PRIOR, ADD = 8.0, 0.5
#: Text of a block, in bytes (a longer text is a block of its own), and text whose keys a part sums.
BLOCK_BYTES, PART_BYTES = 8 << 20, 8 << 20
#: A sender cuts its keys into at most FAN parts, and about FAN senders meet in one.
FAN_BITS = 8
FAN = 1 << FAN_BITS
SENT = "part long, block long, keys binary"
ANSWERED = "block long, part long, data binary, words long, t long, b long"
#: Hashes of the start of a text (a history alone) and of its end (a word like any other).
START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814E)
#: Results, in order.
OUT = ("n_tokens", "target_loss", "background_loss", "score")


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers of one length: narrow, byte by byte, compressed."""
    out = [struct.pack("<q", len(arrays[0]))]
    for a in arrays:
        a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
        out += [struct.pack("<b", a.itemsize), a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = struct.unpack_from("<q", raw)[0], 8, []
    while at < len(raw):
        width = raw[at]
        planes = np.frombuffer(raw, np.uint8, n * width, at + 1).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += 1 + n * width
    return out


class _Tokens:
    """The tokens of a block: every word of every text, and END behind the last of each text that has one."""

    def __init__(self, texts: pa.ChunkedArray) -> None:
        words, pairs, counts = [], [], []
        for _, n, data, off in slices(texts):
            w = Words(data, off)
            length = w.count + (w.count > 0)
            last = np.cumsum(length)[w.count > 0] - 1
            h = np.empty(length.sum(), np.uint64)
            inner = np.ones(len(h), bool)
            inner[last] = False
            h[inner], h[last] = w.hashes(w.start, w.end), END
            before = np.empty_like(h)
            before[1:] = h[:-1]
            before[(np.cumsum(length) - length)[length > 0]] = START
            with np.errstate(over="ignore"):
                pairs.append(mix(before * np.uint64(0x9E3779B97F4A7C55) + h) | np.uint64(1))
            words.append(h & ~np.uint64(1))  # words are even, bigrams odd
            counts.append(length)
        self.length = np.concatenate([*counts, np.zeros(0, np.int64)])
        self.size = int(self.length.sum())
        self.doc = np.repeat(np.arange(len(self.length)), self.length)
        self.keys = np.concatenate([*words, *pairs, np.zeros(0, np.uint64)])

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sorted distinct keys, the order that sorts all keys, and where each distinct one begins in it."""
        order = np.argsort(self.keys, kind="stable")
        s = self.keys[order]
        at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        return s[at], order, at


def _blocks(rows: DataFrame) -> DataFrame:
    """rows (with _text) as (block, bytes, rows): runs of about BLOCK_BYTES of text, in Arrow's stream format."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            nonlocal block, held, size
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(pa.Table.from_batches(held).combine_chunks())
            made = pa.RecordBatch.from_arrays([pa.array([block]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "bytes", "rows"])
            block, held, size = block + 1, [], 0
            return made

        for b in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index("_text"))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < b.num_rows:
                before = int(upto[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(upto, before + BLOCK_BYTES - size, "right")))
                held.append(b.slice(at, end - at))
                size += int(upto[end - 1]) - before
                at = end
                if size >= BLOCK_BYTES or at < b.num_rows:
                    yield out()
        if held:
            yield out()

    tune_arrow(rows.sparkSession)
    return stored(rows.mapInArrow(run, "block long, bytes long, rows binary"), "lm-blocks")


def _table(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def _flag(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def _by_part(keys: np.ndarray, sides: list[np.ndarray], bits: int) -> tuple[np.ndarray, list[bytes]]:
    """Sorted keys with their counts, cut by their first `bits` bits: the parts that occur and a blob for each."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    step = np.diff(keys, prepend=np.uint64(0))
    step[edge[:-1]] = keys[edge[:-1]]
    return part[edge[:-1]], [_packed(step[x:y], *(v[x:y] for v in sides)) for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _sent_row(sender: int, keys: np.ndarray, sides: list[np.ndarray], bits: int) -> pa.RecordBatch:
    parts, blobs = _by_part(keys, sides, bits)
    return pa.RecordBatch.from_arrays([pa.array(parts), pa.array([sender] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "block", "keys"])


def _sent(blocks: DataFrame, bits: int) -> DataFrame:
    """part, block, keys: the distinct keys of each block with their counts on both sides, by part of the key space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, rows in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                table = _table(rows)
                tokens = _Tokens(table.column("_text"))
                keys, order, at = tokens.distinct()
                if not len(keys):
                    continue
                sides = []
                for c in ("_t", "_b"):
                    each = np.repeat(_flag(table, c), tokens.length)
                    sides.append(np.add.reduceat(np.concatenate([each, each])[order], at))
                yield _sent_row(block, keys, sides, bits)

    return blocks.select("block", "rows").mapInArrow(run, SENT)


def _summed(blobs: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Of blobs of sorted keys: the sorted distinct keys, their sums, each key's place in them, and where each blob starts."""
    parts = [_unpacked(x) for x in blobs]
    keys = np.concatenate([np.cumsum(p[0].astype(np.uint64), dtype=np.uint64) for p in parts])
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    at, group = np.flatnonzero(new), np.empty(len(s), np.int64)
    group[order] = np.cumsum(new) - 1
    sums = [np.add.reduceat(np.concatenate([p[k].astype(np.int64) for p in parts])[order], at) for k in (1, 2)]
    return s[at], sums, group, np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of rows with one value in the first column, and the other columns of each."""
    now, held = None, []
    for b in batches:
        for key, *rest in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True):
            if key != now and held:
                yield now, held
                held = []
            now = key
            held.append(tuple(rest))
    if held:
        yield now, held


def _answers(part: int, blocks: list[int], sums: list[np.ndarray], group: np.ndarray, edge: np.ndarray, stats: tuple[int, int, int] = (0, 0, 0)) -> pa.RecordBatch:
    blobs = [_packed(*(v[group[x:y]] for v in sums)) for x, y in zip(edge, edge[1:], strict=False)]
    n = len(blocks)
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([part] * n, pa.int64()), pa.array(blobs, pa.binary()), *(pa.array([v] + [0] * (n - 1), pa.int64()) for v in stats)], names=["block", "part", "data", "words", "t", "b"])


def _answered(sent: DataFrame) -> DataFrame:
    """block, part, data: the sums of both sides for each key that the block sent, in its order; and in
    one row a part, words and tokens of either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches):
            keys, sums, group, edge = _summed([r[1] for r in rows])
            word = keys & np.uint64(1) == 0
            yield _answers(part, [r[0] for r in rows], sums, group, edge, (int(word.sum()), int(sums[0][word].sum()), int(sums[1][word].sum())))

    parts = sent.repartition("part").sortWithinPartitions("part", "block")
    return stored(parts.mapInArrow(run, ANSWERED), "lm-counts")


def _relayed(sent: DataFrame, senders: int, done: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """The answers to sent (whose parts are the first `done` bits of the keys), and those of the last parts.

    While bits are left, up to some FAN senders of a part meet at a relay, which sends the
    sums of its distinct keys on by the next bits, and later answers its senders from its
    own answers. So a sender has at most FAN blobs at any size of the input, and a relay
    holds about as many keys as a block."""
    if done >= bits:
        counts = _answered(sent)
        return counts, counts
    relays = -(-senders // FAN)
    to = F.shiftleft(F.pmod(F.xxhash64("block"), F.lit(relays)), done).bitwiseOR(F.col("part"))
    sent = stored(sent.withColumn("relay", to), "lm-sent")
    upto = min(bits, done + FAN_BITS)

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for relay, rows in _grouped(batches):
            keys, sums, *_ = _summed([r[1] for r in rows])
            yield _sent_row(relay, keys, sums, upto)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for relay, rows in _grouped(batches):
            own = [r for r in rows if r[1]]
            sums = [np.concatenate(x) for x in zip(*(_unpacked(r[2]) for r in rows if not r[1]), strict=True)]
            _, _, group, edge = _summed([r[2] for r in own])
            yield _answers(relay & ((1 << done) - 1), [r[0] for r in own], sums, group, edge)

    met = sent.select("relay", "block", "keys").repartition("relay").sortWithinPartitions("relay", "block")
    back, last = _relayed(met.mapInArrow(up, SENT), relays, upto, bits)
    # The answers of a relay, by part, come before what its senders sent.
    rows = back.select(F.col("block").alias("relay"), F.col("part").alias("block"), F.lit(False).alias("is_own"), F.col("data"))
    rows = rows.unionByName(sent.select("relay", "block", F.lit(True).alias("is_own"), F.col("keys").alias("data")))
    rows = rows.repartition("relay").sortWithinPartitions("relay", "is_own", "block").select("relay", "block", "is_own", "data")
    return stored(rows.mapInArrow(down, ANSWERED), "lm-answers"), last


def _losses(table: pa.Table, counts: list[bytes], words: int, totals: tuple[int, int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each text of a block, and its mean losses under both models."""
    tokens = _Tokens(table.column("_text"))
    keys, order, at = tokens.distinct()
    group, new = np.empty(len(order), np.int64), np.zeros(len(order), np.int64)
    new[at] = 1
    group[order] = np.cumsum(new) - 1
    size, doc, length = tokens.size, tokens.doc, tokens.length
    sums = [np.concatenate(x).astype(np.float64) for x in zip(*map(_unpacked, counts), strict=True)] or [np.zeros(0)] * 2
    word, pair = group[:size], group[size:]
    own_word, own_pair = (runs(doc, g.astype(np.uint64))[0] for g in (word, pair))
    first = np.zeros(size, bool)
    first[(np.cumsum(length) - length)[length > 0]] = True
    end = np.searchsorted(keys, END & ~np.uint64(1))
    losses = []
    for name, c, total in zip(("_t", "_b"), sums, totals, strict=True):
        own = _flag(table, name)
        mine = own[doc]
        c_word = c[word] - mine * own_word
        c_history = np.empty(size)
        c_history[1:] = c_word[:-1]
        if size:
            c_history[first] = c[end] - mine[first]
        p = (c_word + ADD) / (total - mine * length[doc] + ADD * (words + 1))
        p = (c[pair] - mine * own_pair + PRIOR * p) / (c_history + PRIOR)
        losses.append(np.bincount(doc, weights=-np.log(p), minlength=len(length)) / np.maximum(length, 1))
    return length - (length > 0), losses


def scored(docs: DataFrame, target: Column, background: Column | None = None, text: str = "text") -> DataFrame:
    """docs with its text column replaced by n_tokens, target_loss, background_loss and score
    (losses are means over the words and the end of a text, rounded to nine places; score
    is their difference).

    The target is every row for which `target` holds, the background every row for which
    `background` does (by default all); null is false. Rows of neither are scored too.
    Each row is left out of the models it is scored by. A text without words, or null,
    has losses and score 0 and is in no model; a side without words gives every word the
    same loss. Rows with equal texts and flags score alike; other columns pass through,
    and one named like a result (or _text, _t, _b) raises; an empty table stays empty.
    Words are told apart by 64-bit hashes, upper case from lower."""
    others = [f for f in docs.schema.fields if f.name != text]
    clash = {f.name.lower() for f in others} & {*OUT, "_text", "_t", "_b"}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    background = F.lit(True) if background is None else background
    flag = lambda c: F.coalesce(c.cast("boolean"), F.lit(False)).cast("int")
    blocks = _blocks(docs.select(*[F.col(f"`{f.name}`") for f in others], F.col(text).alias("_text"), flag(target).alias("_t"), flag(background).alias("_b")))
    size, many = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    bits = max(0, (size // PART_BYTES).bit_length())
    first = min(bits, FAN_BITS)
    counts, last = _relayed(_sent(blocks, first), max(many, 1), first, bits)
    words, *totals = last.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "t", "b")]).first()
    names = [f.name for f in others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for block, part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if block != now:
                    now, held = block, []
                if part >= 0:
                    held.append(data.as_py())
                    continue
                table = _table(data)
                n, (t, b_) = _losses(table, held, words, tuple(totals))
                t, b_ = np.round(t, 9) + 0.0, np.round(b_, 9) + 0.0
                out = table.select(names).combine_chunks()
                for c, v in zip(OUT, (n, t, b_, np.round(t - b_, 9) + 0.0), strict=True):
                    out = out.append_column(c, pa.array(v))
                yield from out.to_batches(10_000)

    # The sums of a block come before its rows, whose part is -1: both ascending by the negated part.
    both = counts.select("block", "part", "data").unionByName(blocks.select("block", F.lit(-1).cast("long").alias("part"), F.col("rows").alias("data")))
    both = both.repartition("block").sortWithinPartitions("block", F.col("part") < 0, "part")
    kinds = [LongType(), DoubleType(), DoubleType(), DoubleType()]
    return both.mapInArrow(run, StructType([*others, *(StructField(c, k) for c, k in zip(OUT, kinds, strict=True))]))


def with_good(docs: DataFrame, labels: DataFrame, name: str = "is_good") -> DataFrame:
    """docs and whether a document is labelled of good quality and not toxic.

    Labels have no proven bound, so they are not broadcast: both sides are sorted by id."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_good_id")).distinct()
    return docs.join(good.hint("merge"), F.col("doc_id") == F.col("_good_id"), "left").withColumn(name, F.col("_good_id").isNotNull()).drop("_good_id")
