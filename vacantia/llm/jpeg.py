"""Progressive JPEG media columns.

Scans of spectral selection and successive approximation are accumulated into
coefficient arrays, which an exact integer inverse transform in numpy turns into
planes; chroma is upsampled and RGB tensors come out at full resolution. Entropy
coded data is decoded in lockstep: every restart interval of every image of a
batch is a lane, and each numpy step decodes one symbol of every lane.

A payload of bytes is stored losslessly as quantised coefficients (the format's
unit), each byte less 128, in a 4:2:0 image with quantisation steps of one.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import refuse, tune_arrow

_diagonals = sorted(((x + y, (x if (x + y) % 2 else y), x, y) for x in range(8) for y in range(8)), key=lambda t: (t[0], t[1]))
#: Natural position (row * 8 + column) of each zigzag position.
ZIGZAG = np.array([x * 8 + y for _, _, x, y in _diagonals])
#: How the payload's images are coded: (components, first, last, high bit, low bit) of each scan.
SCRIPT = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 9, 0, 1), ((1,), 1, 63, 0, 0), ((2,), 1, 63, 0, 0), ((0,), 10, 63, 0, 0), ((0,), 1, 9, 1, 0), ((0, 1, 2), 0, 0, 1, 0)]
#: Restart intervals: MCUs of scans of all components, blocks of scans of one.
RESTART_DC, RESTART_AC = 16, 4
#: Lanes that are encoded at a time, and blocks that are transformed at a time: long payloads need little more than their own size.
LANES, BLOCKS = 1 << 12, 1 << 13
#: Bytes that are coded at a time, and of an Arrow batch: they bound what a Python worker holds.
BATCH, ARROW = 1 << 19, 4 << 20
_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


class JpegError(ValueError):
    """Not a whole progressive JPEG that this decoder knows."""


def _codes(lengths: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Code and length of each symbol, and the DHT body, of a canonical Huffman code."""
    code, value, size = 0, np.zeros(256, np.int64), np.zeros(256, np.int64)
    counts, order, last = [0] * 16, [], 0
    for n, symbols in lengths:
        code <<= n - last
        last = n
        for s in symbols:
            value[s], size[s] = code, n
            code += 1
        counts[n - 1] = len(symbols)
        order += symbols
    return value, size, bytes(counts) + bytes(order)


#: Four bits for short runs of the sizes that text has, twelve for all else; DC sizes have four.
_AC = _codes([(4, [0, 1, 2, 3, 4, 5, 6, 7]), (12, list(range(8, 256)))])
_DC = _codes([(4, list(range(12)))])


_bit_length = np.array([v.bit_length() for v in range(1 << 12)])


def _sizes(v: np.ndarray) -> np.ndarray:
    """Bits of |v|, which is below 4096."""
    return _bit_length[np.abs(v)]


def _pack(lane: np.ndarray, value: np.ndarray, bits: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (in lane order) as bytes, each lane padded with ones; and where lanes start."""
    upto = np.zeros(len(bits) + 1, np.int64)
    np.cumsum(bits, out=upto[1:])
    first = np.searchsorted(lane, np.arange(lanes + 1))
    total = upto[first[1:]] - upto[first[:-1]]
    size = -(-total // 8)
    start = np.zeros(lanes + 1, np.int64)
    np.cumsum(size, out=start[1:])
    at = upto[:-1] - upto[first[lane]] + start[lane] * 8
    # A token lies within three 16-bit words; tokens share no bits, so words are sums.
    wide = value << (48 - (at & 15) - bits)
    out = np.zeros(start[-1] // 2 + 4)
    for j in range(3):
        out += np.bincount((at >> 4) + j, weights=wide >> (32 - 16 * j) & 0xFFFF, minlength=len(out))[: len(out)]
    out = out.astype(">u2").view(np.uint8)[: start[-1]].copy()
    full = size > 0
    out[start[1:][full] - 1] |= ((1 << (size * 8 - total)[full]) - 1).astype(np.uint8)
    return out, start


def _stuffed(data: np.ndarray, start: np.ndarray, marker: np.ndarray) -> tuple[bytes, np.ndarray]:
    """FF becomes FF 00, and a lane with a marker number of 0 to 7 is followed by that restart marker."""
    times = 1 + (data == 255).astype(np.int64)
    ends = start[1:] - 1
    has = marker >= 0
    times[ends[has]] += 2
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(times, out=place[1:])
    out = np.zeros(place[-1], np.uint8)
    out[place[:-1]] = data
    tail = place[ends[has] + 1]
    out[tail - 2] = 255
    out[tail - 1] = 0xD0 + marker[has]
    return out.tobytes(), place[start]


def _lanes(per: np.ndarray, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For images with `per` units each: the lane of each unit, the first lane of each image, each lane's marker number (-1: last)."""
    n = -(-per // every)
    first = np.concatenate([[0], np.cumsum(n)])
    inside = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    lane = np.repeat(first[:-1], per) + inside // every
    k = np.arange(first[-1]) - np.repeat(first[:-1], n)
    return lane, first, np.where(k == np.repeat(n, n) - 1, -1, k % 8)


def _encode_scan(blocks: np.ndarray, lane: np.ndarray, lanes: int, comp: np.ndarray, scan: tuple) -> tuple[np.ndarray, np.ndarray]:
    """One scan of all images: blocks (zigzag) in the order of the scan."""
    _, ss, se, high, low = scan
    if ss == 0:
        dc = blocks[:, 0]
        if high:
            return _pack(lane, (dc >> low) & 1, np.ones(len(dc), np.int64), lanes)
        v = dc >> low
        diff = v.copy()
        for c in np.unique(comp):  # the difference to the block of the component before, within the lane
            at = np.flatnonzero(comp == c)
            same = lane[at[1:]] == lane[at[:-1]]
            diff[at[1:][same]] = v[at[1:][same]] - v[at[:-1][same]]
        s = _sizes(diff)
        extra = np.where(diff < 0, diff + (1 << s) - 1, diff)
        return _pack(lane, (_DC[0][s] << s) | extra, _DC[1][s] + s, lanes)
    band = blocks[:, ss : se + 1]
    size = np.abs(band)
    n, width = band.shape
    if not high:
        size = size >> low
        b, k = np.nonzero(size)
        before = np.full(len(b), -1)
        same = b[1:] == b[:-1]
        before[1:][same] = k[:-1][same]
        run = k - before - 1
        mag = size[b, k]
        s = _sizes(mag)
        extra = np.where(band[b, k] < 0, (1 << s) - 1 - mag, mag)
        sym = (run % 16) << 4 | s
        token, bits = (_AC[0][sym] << s) | extra, _AC[1][sym] + s
        key = (b * 64 + k) * 4 + 3
        jump = np.repeat(np.arange(len(b)), run // 16)
        last = np.full(n, -1)
        last[b] = k  # in order: the last one stays
        rest = np.flatnonzero(last < width - 1)
        key = np.concatenate([key, key[jump] - 1, rest * 256 + 255])
        token = np.concatenate([token, np.full(len(jump), _AC[0][0xF0]), np.full(len(rest), _AC[0][0])])
        bits = np.concatenate([bits, np.full(len(jump), _AC[1][0xF0]), np.full(len(rest), _AC[1][0])])
    else:  # refinement by one bit of a band of at most 16, so no run needs a jump
        old, new = size >> high > 0, size >> low == 1
        seg = np.cumsum(new, axis=1) - new  # how many new ones come before
        zero = ~old & ~new
        zeros = np.cumsum(zero, axis=1)
        b, k = np.nonzero(new)
        same = np.zeros(len(b), bool)
        same[1:] = b[1:] == b[:-1]
        base = np.zeros(len(b), np.int64)
        base[1:] = np.where(same[1:], zeros[b[:-1], k[:-1]], 0)
        sym = (zeros[b, k] - base) << 4 | 1
        token = (_AC[0][sym] << 1) | (band[b, k] > 0)
        bits = _AC[1][sym] + 1
        key = (b * 64 + seg[b, k]) * 128
        cb, ck = np.nonzero(old)
        count = new.sum(axis=1)
        lastnew = np.where(new.any(axis=1), width - 1 - np.argmax(new[:, ::-1], axis=1), -1)
        rest = np.flatnonzero(lastnew < width - 1)
        key = np.concatenate([key, (cb * 64 + seg[cb, ck]) * 128 + 1 + ck, (rest * 64 + count[rest]) * 128])
        token = np.concatenate([token, (size[cb, ck] >> low) & 1, np.full(len(rest), _AC[0][0])])
        bits = np.concatenate([bits, np.ones(len(cb), np.int64), np.full(len(rest), _AC[1][0])])
    order = np.argsort(key, kind="stable")
    shift = 8 if not high else 13
    return _pack(lane[key[order] >> shift], token[order], bits[order], lanes)


def _encoded(blocks: np.ndarray, lane: np.ndarray, comp: np.ndarray, marker: np.ndarray, scan: tuple) -> tuple[bytes, np.ndarray]:
    """One scan of all images with its restart markers, and where lanes start; lanes depend on no others."""
    parts, place = [], [np.zeros(1, np.int64)]
    for a in range(0, len(marker), LANES):
        b = min(a + LANES, len(marker))
        x, y = np.searchsorted(lane, [a, b])
        made, at = _encode_scan(blocks[x:y].astype(np.int64), lane[x:y] - a, b - a, comp[x:y], scan)
        body, starts = _stuffed(made, at, marker[a:b])
        parts.append(body)
        place.append(starts[1:] + place[-1][-1])
    return b"".join(parts), np.concatenate(place)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode_payloads(payloads: list[bytes], across: int = 64) -> list[bytes]:
    """Each payload as a progressive 4:2:0 JPEG whose coefficients are its bytes less 128.

    A comment holds the payload's length; coefficients past it are zero. MCUs are in
    rows of at most `across`, and of more in payloads too long for 4095 such rows."""
    if not payloads:
        return []
    size = np.array([len(p) for p in payloads])
    mcus = np.maximum(1, -(-size // 384))
    wide = np.minimum(mcus, np.maximum(across, -(-mcus // 4095)))
    rows = -(-mcus // wide)
    if (wide > 4095).any():
        raise JpegError("a payload is too long for one image")
    mcus = wide * rows
    start = np.concatenate([[0], np.cumsum(mcus)])
    flat = np.zeros(start[-1] * 384, np.int16)
    for p, a in zip(payloads, start[:-1] * 384, strict=True):
        flat[a : a + len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) - 128
    blocks = flat.reshape(-1, 6, 64)
    # Luma blocks in raster order of each image, for the scans of one component.
    luma = np.empty(start[-1] * 4, np.int64)
    for i in range(len(payloads)):
        ids = np.arange(start[i] * 4, start[i + 1] * 4).reshape(rows[i], wide[i], 2, 2).transpose(0, 2, 1, 3)
        luma[start[i] * 4 : start[i + 1] * 4] = ids.ravel()
    planes = {0: blocks[:, :4].reshape(-1, 64)[luma], 1: blocks[:, 4], 2: blocks[:, 5]}
    scans = []
    for scan in SCRIPT:
        comps = scan[0]
        if len(comps) > 1:
            units, every = mcus, RESTART_DC
            lane, first, marker = _lanes(units, every)
            lane, comp, data = np.repeat(lane, 6), np.tile([0, 0, 0, 0, 1, 2], start[-1]), blocks.reshape(-1, 64)
        else:
            units, every = mcus * (4 if comps[0] == 0 else 1), RESTART_AC
            lane, first, marker = _lanes(units, every)
            comp, data = np.zeros(len(lane), int), planes[comps[0]]
        body, place = _encoded(data, lane, comp, marker, scan)
        head = _segment(0xDD, struct.pack(">H", every)) + _segment(0xDA, bytes([len(comps)]) + b"".join(bytes([c + 1, 0]) for c in comps) + bytes([scan[1], scan[2], scan[3] << 4 | scan[4]]))
        scans.append((head, body, place[first]))
    tables = _segment(0xC4, b"\x00" + _DC[2]) + _segment(0xC4, b"\x10" + _AC[2])
    quant = _segment(0xDB, b"\x00" + b"\x01" * 64)
    out = []
    for i in range(len(payloads)):
        frame = _segment(0xC2, struct.pack(">BHHB", 8, 16 * rows[i], 16 * wide[i], 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00")
        parts = [b"\xff\xd8", _segment(0xFE, b"payload=%d" % size[i]), quant, frame, tables]
        for head, body, place in scans:
            parts += [head, body[place[i] : place[i + 1]]]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


class Image:
    """What the markers of one JPEG say; its coefficients are filled in by decode()."""

    def __init__(self, data: bytes) -> None:
        if data[:2] != b"\xff\xd8":
            raise JpegError("no start of image")
        self.quant: dict[int, np.ndarray] = {}
        self.comment, self.parts, self.scans = b"", [], []
        tables: dict[int, bytes] = {}
        at, every = 2, 0
        while True:
            if at + 2 > len(data) or data[at] != 0xFF:
                raise JpegError(f"no marker at byte {at}")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xD9:
                break
            n = int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + n]
            if len(body) != n - 2:
                raise JpegError("a segment is cut off")
            at += 2 + n
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    raw = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                    self.quant[body[0] & 15] = raw.astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    k = 17 + sum(body[1:17])
                    tables[body[0]] = body[1:k]
                    body = body[k:]
            elif marker == 0xDD:
                every = int.from_bytes(body, "big")
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xC2:
                bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                if bits != 8 or n not in (1, 3) or not self.height or not self.width:
                    raise JpegError("only 8-bit images of one or three components")
                comps = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                self.hmax, self.vmax = max(c[1] for c in comps), max(c[2] for c in comps)
                self.across, self.down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
                base = 0
                for cid, h, v, q in comps:
                    stride, tall = self.across * h, self.down * v
                    own = (-(-(-(-self.width * h // self.hmax)) // 8), -(-(-(-self.height * v // self.vmax)) // 8))
                    self.parts.append({"id": cid, "h": h, "v": v, "q": q, "base": base, "stride": stride, "tall": tall, "own": own, "passes": defaultdict(int)})
                    base += stride * tall
                self.blocks = base
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise JpegError("not a progressive Huffman-coded image")
            elif marker == 0xDA:
                if not self.parts:
                    raise JpegError("a scan before the frame")
                n = body[0]
                chosen = []
                for i in range(n):
                    k = next((j for j, p in enumerate(self.parts) if p["id"] == body[1 + 2 * i]), None)
                    if k is None:
                        raise JpegError("a scan of an unknown component")
                    chosen.append((k, body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15))
                ss, se, a = body[1 + 2 * n : 4 + 2 * n]
                if ss > se or se > 63 or (ss == 0 and se) or (ss and n > 1):
                    raise JpegError("a scan of an impossible band")
                end = _END.search(data, at)
                if not end:
                    raise JpegError("a scan without an end")
                level = max(self.parts[k]["passes"][z] for k, _, _ in chosen for z in range(ss, se + 1))
                for k, _, _ in chosen:
                    for z in range(ss, se + 1):
                        self.parts[k]["passes"][z] = level + 1
                need = [tables.get((16 | t[2]) if ss else t[1]) for t in chosen]
                if not (ss == 0 and a >> 4) and None in need:
                    raise JpegError("a scan without its Huffman table")
                self.scans.append((level, ss, se, a >> 4, a & 15, [k for k, _, _ in chosen], need, every, data[at : end.start()]))
                at = end.start()
        if not self.parts:
            raise JpegError("no frame")

    def order(self, comps: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
        """The blocks of a scan in order, the component of each, and the blocks of an MCU."""
        if len(comps) == 1:
            p = self.parts[comps[0]]
            ids = p["base"] + (np.arange(p["own"][1])[:, None] * p["stride"] + np.arange(p["own"][0])[None, :]).ravel()
            return ids, np.full(len(ids), comps[0]), 1
        cols, kinds = [], []
        y, x = np.divmod(np.arange(self.across * self.down), self.across)
        for k in comps:
            p = self.parts[k]
            for v in range(p["v"]):
                for h in range(p["h"]):
                    cols.append(p["base"] + (y * p["v"] + v) * p["stride"] + x * p["h"] + h)
                    kinds.append(k)
        return np.stack(cols, axis=1).ravel(), np.tile(kinds, len(y)), len(cols)


_luts: dict[bytes, np.ndarray] = {}


def _lut(table: bytes) -> np.ndarray:
    """length << 8 | symbol for every 16 bits; 0 if no code fits."""
    if table not in _luts:
        out, code, at = np.zeros(1 << 16, np.uint16), 0, 16
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | table[at]
                code, at = code + 1, at + 1
            code <<= 1
        _luts[table] = out
    return _luts[table]


class _Bits:
    """Lanes of bits in one buffer: pos is where each lane reads next."""

    def __init__(self, pieces: list[bytes]) -> None:
        """pieces: the coded data of scans, restart markers included."""
        raw = np.frombuffer(b"\x00".join([b"", *pieces, b"\x00" * 8]), np.uint8)
        edge = np.cumsum([1, *(len(p) + 1 for p in pieces)])[:-1] if pieces else np.zeros(0, int)
        ff = np.flatnonzero(raw[:-1] == 255)
        after = raw[ff + 1]
        keep = np.ones(len(raw), bool)
        keep[ff[after == 0] + 1] = False
        rst = ff[(after & 0xF8) == 0xD0]
        keep[rst] = keep[rst + 1] = False
        place = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(keep, out=place[1:])
        data = np.concatenate([raw[keep], np.zeros(8, np.uint8)]).astype(np.uint32)
        self.word = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
        begin = np.sort(np.concatenate([edge, rst + 2]))
        self.pos = place[begin] * 8
        self.of = np.searchsorted(edge, begin, "right") - 1  # the scan of each lane
        ends = np.array([len(p) for p in pieces], np.int64) + edge
        follow = np.concatenate([begin[1:], [1 << 60]])
        self.limit = place[np.minimum(follow, ends[self.of])] * 8

    def peek(self, pos: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """n (at most 25) bits from pos on."""
        w = self.word[np.minimum(pos >> 3, len(self.word) - 1)].astype(np.uint64) << np.uint64(32)
        return ((w << (pos & 7).astype(np.uint64)) >> np.uint64(1) >> (np.uint64(63) - np.uint64(n) if isinstance(n, int) else (63 - n).astype(np.uint64))).astype(np.int64)


def _decode(scans: list[tuple], coef: np.ndarray) -> None:
    """Scans of one kind (first or refining, DC or AC) of any number of images:
    (ss, se, high, low, order, kinds, blocks per MCU, tables, every, data)."""
    bits = _Bits([s[9] for s in scans])
    per = np.array([len(s[4]) for s in scans])
    start = np.cumsum(per) - per
    order = np.concatenate([s[4] for s in scans])
    step = np.array([s[8] * s[6] if s[8] else max(1, len(s[4])) for s in scans])
    lane = bits.of
    inside = np.arange(len(lane)) - np.searchsorted(lane, np.arange(len(scans)))[lane]
    expect = np.maximum(1, -(-per // step))
    if not np.array_equal(np.bincount(lane, minlength=len(scans)), expect):
        raise JpegError("restart markers do not fit the image")
    first = start[lane] + inside * step[lane]
    count = np.minimum(step[lane], per[lane] - inside * step[lane])
    pos, limit = bits.pos.copy(), bits.limit
    field = lambda k: np.array([s[k] for s in scans])[lane]
    ss, se, high, low = field(0), field(1), field(2), field(3)
    if scans[0][0] == 0 and scans[0][2]:  # DC refinement: a bit a block
        which = np.repeat(np.arange(len(lane)), count)
        k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        coef[order[first[which] + k], 0] |= (bits.peek(pos[which] + k, 1) << low[which]).astype(coef.dtype)
        if (pos + count > limit).any():
            raise JpegError("a scan is cut off")
        return
    tables = list(dict.fromkeys(t for s in scans for t in s[7]))
    lut = np.concatenate([_lut(t) for t in tables])
    if scans[0][0] == 0:  # DC, first pass
        kinds = np.concatenate([s[5] for s in scans])
        number = np.zeros((len(scans), 4), np.int64)
        for i, s in enumerate(scans):
            for k, t in zip(dict.fromkeys(s[5].tolist()), s[7], strict=False):
                number[i, k] = tables.index(t) << 16
        pred = np.zeros((len(lane), 4), np.int64)
        for b in range(int(count.max(initial=0))):
            a = np.flatnonzero(b < count)
            at = first[a] + b
            kind = kinds[at]
            got = lut[number[lane[a], kind] + bits.peek(pos[a], 16)]
            s = (got & 255).astype(np.int64)
            if (got == 0).any() or (s > 11).any():
                raise JpegError("no such code")
            p = pos[a] + (got >> 8)
            v = bits.peek(p, s)
            pos[a] = p + s
            pred[a, kind] += np.where(v < (1 << s) >> 1, v - (1 << s) + 1, v)
            coef[order[at], 0] = pred[a, kind] << low[a]
        if (pos > limit).any():
            raise JpegError("a scan is cut off")
        return
    number = np.array([tables.index(s[7][0]) << 16 for s in scans])[lane]
    flat = coef.reshape(-1)
    refine = bool(scans[0][2])
    a = np.arange(len(lane))
    block, k = np.zeros(len(lane), np.int64), ss.copy()
    tail = np.zeros(len(lane), np.int64)  # blocks still to be corrected only
    a = a[count > 0]
    width = int((se - ss).max(initial=0)) + 1
    while len(a):
        if not refine:
            p = pos[a]
            got = lut[number[a] + bits.peek(p, 16)].astype(np.int64)
            if not got.all():
                raise JpegError("no such code")
            p += got >> 8
            r, s = (got >> 4) & 15, got & 15
            n = np.where(s > 0, s, np.where(r < 15, r, 0))
            v = bits.peek(p, n)
            pos[a] = p + n
            to = k[a] + r
            real = s > 0
            if (to[real] > 63).any():
                raise JpegError("a run past the block")
            at = a[real]
            vr, sr = v[real], s[real]
            flat[order[first[at] + block[at]] * 64 + to[real]] = np.where(vr < (1 << sr) >> 1, vr - (1 << sr) + 1, vr) << low[at]
            end = (s == 0) & (r < 15)
            to += 1
            over = end | (to > se[a])
            block[a] += np.where(end, (1 << np.where(end, r, 0)) + v, over)
            k[a] = np.where(over, ss[a], to)
        else:
            fresh = tail[a] == 0
            p = pos[a]
            got = np.where(fresh, lut[number[a] + bits.peek(p, 16)].astype(np.int64), 0)
            if not got[fresh].all():
                raise JpegError("no such code")
            p += got >> 8
            r, s = (got >> 4) & 15, got & 15
            end = fresh & (s == 0) & (r < 15)
            n = np.where(end, r, np.where(fresh, s, 0))
            v = bits.peek(p, n)
            p += n
            tail[a] = np.where(end, (1 << np.where(end, r, 0)) + v, tail[a])
            bulk = tail[a] > 0
            where = order[first[a] + block[a]] * 64
            col = ss[a][:, None] + np.arange(width)
            live = (col >= k[a][:, None]) & (col <= se[a][:, None])
            old = flat[where[:, None] + np.minimum(col, 63)]
            zero = live & (old == 0)
            hit = zero & (np.cumsum(zero, axis=1) == (r + 1)[:, None]) & ~bulk[:, None]
            found = hit.any(axis=1)
            stop = np.where(found, ss[a] + np.argmax(hit, axis=1), se[a] + 1)
            fix = live & (old != 0) & (col < stop[:, None])
            nth = np.cumsum(fix, axis=1)
            i, j = np.nonzero(fix)
            bit = bits.peek(p[i] + nth[i, j] - 1, 1)
            now = old[i, j].astype(np.int64)
            unit = 1 << low[a][i]
            turn = (bit == 1) & ((np.abs(now) & unit) == 0)
            flat[(where[i] + col[i, j])[turn]] = (now + np.sign(now) * unit)[turn]
            pos[a] = p + nth[:, -1]
            new = found & (s > 0)
            flat[where[new] + stop[new]] = np.where(v[new] == 1, 1, -1) << low[a][new]
            over = bulk | (stop >= se[a])
            tail[a] -= bulk
            block[a] += over
            k[a] = np.where(over, ss[a], stop + 1)
        a = a[block[a] < count[a]]
    if (pos > limit).any():
        raise JpegError("a scan is cut off")


def decode(data: list[bytes]) -> tuple[list[Image], list[np.ndarray]]:
    """The images and their quantised coefficients (blocks x 64, zigzag), all scans accumulated."""
    images = [Image(d) for d in data]
    base = np.concatenate([[0], np.cumsum([i.blocks for i in images])]).astype(np.int64)
    coef = np.zeros((base[-1], 64), np.int32)
    groups: dict[tuple, list] = defaultdict(list)
    for image, b in zip(images, base, strict=False):
        seen: dict[tuple, tuple] = {}
        for level, ss, se, high, low, comps, tables, every, body in image.scans:
            key = tuple(comps)
            if key not in seen:
                ids, kinds, per = image.order(comps)
                seen[key] = (ids + b, kinds, per)
            ids, kinds, per = seen[key]
            groups[(level, ss > 0, high > 0)].append((ss, se, high, low, ids, kinds, per, tables, every, body))
    for key in sorted(groups):
        _decode(groups[key], coef)
    return images, [coef[a:b] for a, b in zip(base, base[1:], strict=False)]


_SCALE = 12
_cosines = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: The inverse transform of zigzag coefficients, in integers of 1/4096: sums stay far below 2**53, so that results do not depend on the order of summing.
_INVERSE = np.round(np.kron(_cosines, _cosines)[ZIGZAG] * (1 << _SCALE))


def tensors(images: list[Image], coef: list[np.ndarray]) -> list[np.ndarray]:
    """Full-resolution RGB (height x width x 3, uint8) of each image."""
    if not images:
        return []
    scaled = []
    for image, c in zip(images, coef, strict=True):
        for p in image.parts:
            q = image.quant.get(p["q"])
            if q is None:
                raise JpegError("no quantisation table")
            if (q != 1).any():
                own = slice(p["base"], p["base"] + p["stride"] * p["tall"])
                c = c.astype(np.int64)
                c[own] *= q
        scaled.append(c)
    whole = scaled[0] if len(scaled) == 1 else np.concatenate(scaled)
    samples = np.empty((len(whole), 64), np.uint8)
    for a in range(0, len(whole), BLOCKS):
        s = np.floor((whole[a : a + BLOCKS].astype(np.float64) @ _INVERSE + (1 << (_SCALE - 1))) / (1 << _SCALE)) + 128
        samples[a : a + BLOCKS] = np.clip(s, 0, 255)
    out, at = [], 0
    for image in images:
        planes = []
        for p in image.parts:
            n = p["stride"] * p["tall"]
            plane = samples[at + p["base"] : at + p["base"] + n].reshape(p["tall"], p["stride"], 8, 8).transpose(0, 2, 1, 3).reshape(p["tall"] * 8, p["stride"] * 8)
            v, h = image.vmax // p["v"], image.hmax // p["h"]
            if v * p["v"] != image.vmax or h * p["h"] != image.hmax:
                raise JpegError("only whole upsampling factors")
            plane = plane[: -(-image.height // v), : -(-image.width // h)]
            if v > 1:
                plane = plane.repeat(v, axis=0)
            if h > 1:
                plane = plane.repeat(h, axis=1)
            planes.append(plane[: image.height, : image.width])
        at += image.blocks
        rgb = np.empty((image.height, image.width, 3), np.uint8)
        tall = max(1, BLOCKS * 64 // image.width)
        for top in range(0, image.height, tall):
            rgb[top : top + tall] = _coloured([p[top : top + tall].astype(np.int32) for p in planes])
        out.append(rgb)
    return out


def _coloured(planes: list[np.ndarray]) -> np.ndarray:
    """RGB of planes of luma and chroma, or of luma alone."""
    if len(planes) == 1:
        return planes[0][:, :, None]
    y, b, r = planes[0] << 16, planes[1] - 128, planes[2] - 128
    # 1.402, 0.344136, 0.714136 and 1.772 in 1/65536.
    return np.clip(np.stack([y + 91881 * r, y - 22554 * b - 46802 * r, y + 116130 * b], axis=2) + 32768 >> 16, 0, 255)


def payload(image: Image, coef: np.ndarray) -> bytes:
    """The bytes that encode_payloads stored."""
    found = re.fullmatch(rb"payload=(\d+)", image.comment)
    if not found or len(image.parts) != 3:
        raise JpegError("no payload in this image")
    y, b, r = (coef[p["base"] : p["base"] + p["stride"] * p["tall"]] for p in image.parts)
    y = y.reshape(image.down, 2, image.across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
    flat = np.concatenate([y, b[:, None], r[:, None]], axis=1).ravel()
    return (flat[: int(found[1])] + 128).astype(np.uint8).tobytes()


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if len(sizes) > at:
        yield at, len(sizes)


Batches = Iterator[pa.RecordBatch]


def _encoder(text: str, others: list[str], unit: int, batch: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            size = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            whole = [max(unit, -(-n // unit) * unit) for n in size]
            for i, j in _groups(whole, batch):
                part = b.slice(i, j - i)
                media = encode_payloads([(t or "").encode().ljust(n, b"\xff") for t, n in zip(texts[i:j].to_pylist(), whole[i:j], strict=True)])
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in others), pa.array(size[i:j], pa.int64()), pa.array(media, pa.binary())], names=[*others, "n_bytes", "media"])

    return run


def _decoder(column: str, others: list[str], tensor: bool, batch: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for b in batches:
            stored = b.column(b.schema.get_field_index(column))
            for i, j in _groups(pc.fill_null(pc.binary_length(stored), 0).to_pylist(), batch):
                part, files = b.slice(i, j - i), stored[i:j].to_pylist()
                there = [k for k, f in enumerate(files) if f is not None]
                images, coef = decode([files[k] for k in there])
                rows: dict[int, tuple] = {}
                for k, image, c, rgb in zip(there, images, coef, tensors(images, coef), strict=True):
                    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
                    rows[k] = (image.height, image.width, rgb.tobytes() if tensor else None, payload(image, c) if image.comment.startswith(b"payload=") else None, f"{image.height}x{image.width}:{sums[0]},{sums[1]},{sums[2]}")
                cols = list(zip(*(rows.get(k, (None,) * 5) for k in range(j - i)), strict=True))
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in others), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*others, *_DECODED])

    return run


_DECODED = ("height", "width", "rgb", "payload", "feature")
_ENCODED_KIND, _DECODED_KIND = "n_bytes long, media binary", "height long, width long, rgb binary, payload binary, feature string"


def _mapped(df: DataFrame, run: Callable[[Batches], Batches], kept: list[str], *more: str) -> DataFrame:
    tune_arrow(df.sparkSession, ARROW)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *more]))


def with_media(docs: DataFrame, text: str = "text", unit: int = 576, batch: int = BATCH) -> DataFrame:
    """docs with its text column replaced by n_bytes and media: the text's UTF-8 (null: empty),
    filled with bytes of 255 to a positive multiple of `unit`, as a progressive JPEG.

    Other columns pass through; one named like a result raises. Scans of long texts are
    encoded in slices of restart intervals."""
    others = [c for c in docs.columns if c != text]
    refuse(others, "n_bytes", "media")
    return _mapped(docs, _encoder(text, others, unit, batch), others, _ENCODED_KIND)


def decoded(media: DataFrame, column: str = "media", tensor: bool = True, batch: int = BATCH) -> DataFrame:
    """media with its column replaced by height, width, rgb (bytes, row by row; null unless
    `tensor`), payload (null for images without one) and feature.

    feature: height x width, and the sum of each channel of the RGB tensor. A null
    image gives nulls; a file that is no whole progressive JPEG raises JpegError. Other
    columns pass through; one named like a result raises."""
    others = [c for c in media.columns if c != column]
    refuse(others, *_DECODED)
    return _mapped(media, _decoder(column, others, tensor, batch), others, _DECODED_KIND)


def round_trip(docs: DataFrame, text: str = "text", unit: int = 576, tensor: bool = False, batch: int = BATCH) -> DataFrame:
    """What with_media and then decoded give, with media kept: the files that a batch is stored as are
    read back in the same Python worker, so that a task needs one worker and not two."""
    others = [c for c in docs.columns if c != text]
    refuse(others, "n_bytes", "media", *_DECODED)
    encode, read = _encoder(text, others, unit, batch), _decoder("media", [*others, "n_bytes", "media"], tensor, 2 * batch)
    return _mapped(docs, lambda batches: read(encode(batches)), others, _ENCODED_KIND, _DECODED_KIND)


def media_tables(docs: DataFrame, path: str, text: str = "text", unit: int = 576, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """Two written tables below path: media (with_media's rows), and tensors (decoded's rows with rgb, of the
    files as the first table holds them). Each write ends a lineage, so a lost executor costs single tasks.

    path must be shared by all executors; what stands there already makes the write fail. An empty
    table of documents gives two empty tables; nulls, other columns and clashing names as in with_media."""
    spark = docs.sparkSession
    made = with_media(docs, text, unit, batch)
    made.write.parquet(f"{path}/media")
    media = spark.read.schema(made.schema).parquet(f"{path}/media")
    read = decoded(media, tensor=True, batch=2 * batch)
    read.write.parquet(f"{path}/tensors")
    return media, spark.read.schema(read.schema).parquet(f"{path}/tensors")


def tail_crc(column: str, n: int = 32):
    """The unsigned CRC-32 of the last n bytes of a binary column."""
    return F.crc32(F.substring(F.col(column), -n, n))


