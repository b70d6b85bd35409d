import hashlib
import random

import numpy as np
import pytest

from vacantia.llm import jpeg


@pytest.mark.parametrize("seed", range(4))
def test_round_trip_of_any_bytes(seed):
    r = random.Random(seed)
    pool = [range(256), [126, 127, 128, 129, 130], [127, 128, 129] + [128] * 40, range(97, 123)][seed]
    payloads = [bytes(r.choices(list(pool), k=576 * k)) for k in (1, 2, 7, 40)] + [b"", b"\xff" * 576]
    made = jpeg.encode_payloads(payloads)
    images, coef = jpeg.decode(made)
    assert [jpeg.payload(i, c) for i, c in zip(images, coef, strict=True)] == payloads
    alone = [jpeg.encode_payloads([p])[0] for p in payloads]
    assert alone == made  # a batch changes nothing


def test_scans_are_progressive():
    image = jpeg.Image(jpeg.encode_payloads([bytes(range(256)) * 9])[0])
    kinds = {(ss > 0, high > 0) for _, ss, _, high, *_ in image.scans}
    assert kinds == {(False, False), (False, True), (True, False), (True, True)}


def test_inverse_transform_against_floats():
    rng = np.random.default_rng(1)
    zigzag = rng.integers(-60, 60, 64)
    natural = np.zeros(64)
    natural[jpeg.ZIGZAG] = zigzag
    x = np.arange(8)
    basis = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * k + 1) * u * np.pi / 16) for k in x] for u in x])
    exact = basis.T @ natural.reshape(8, 8) @ basis
    got = (zigzag @ jpeg._INVERSE).reshape(8, 8) / 4096
    assert np.abs(got - exact).max() < 0.5


def test_chroma_is_upsampled_and_flat_grey_is_grey():
    image, coef = jpeg.decode(jpeg.encode_payloads([b"\x80" * 1152]))
    rgb = jpeg.tensors(image, coef)[0]
    assert rgb.shape == (16, 48, 3) and (rgb == 128).all()
    coef[0][-1, 0] = 80  # the last Cr block
    red = jpeg.tensors(image, coef)[0]
    assert (red[:16, 32:, 0] > 128).all() and (red[:, :32] == 128).all()


def test_broken_files():
    whole = jpeg.encode_payloads([b"hello " * 96])[0]
    for bad in (b"", b"\xff\xd8", whole[:100], whole[: len(whole) // 2], whole[:-2], b"\xff\xd8\xff\xc0\x00\x04ab"):
        with pytest.raises(jpeg.JpegError):
            jpeg.decode([bad])


def test_query_columns(spark, docs, empty):
    media = jpeg.with_media(docs.select("doc_id", "text"))
    rows = jpeg.decoded(media).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(rows) == docs.filter("doc_id is not null").count()
    for r in rows:
        raw = (r["text"] or "").encode()
        want = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert r["n_bytes"] == len(raw) and bytes(r["payload"]) == want
        assert len(r["rgb"]) == r["height"] * r["width"] * 3
        assert hashlib.sha256(bytes(r["payload"])).digest() == hashlib.sha256(want).digest()
    both = jpeg.round_trip(docs.select("doc_id", "text"), tensor=True)
    shown = ["doc_id", "n_bytes", "height", "width", "rgb", "payload", "feature"]
    assert sorted(map(repr, both.select(shown).collect())) == sorted(map(repr, jpeg.decoded(media).select(shown).collect()))
    assert sorted(bytes(r[0]) for r in both.select("media").collect()) == sorted(bytes(r[0]) for r in media.select("media").collect())
    assert jpeg.round_trip(empty.select("doc_id", "text")).count() == 0
    assert jpeg.decoded(jpeg.with_media(empty.select("doc_id", "text"))).count() == 0
    gone = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert jpeg.decoded(gone).first()["feature"] is None


def test_slices_change_nothing(monkeypatch):
    payloads = [bytes(random.Random(k).choices(b"abcdef \n", k=576 * (1 + 30 * k))) for k in range(4)]
    made = jpeg.encode_payloads(payloads)
    images, coef = jpeg.decode(made)
    rgb = jpeg.tensors(images, coef)
    monkeypatch.setattr(jpeg, "LANES", 3)
    monkeypatch.setattr(jpeg, "BLOCKS", 2)
    assert jpeg.encode_payloads(payloads) == made
    assert all((a == b).all() for a, b in zip(jpeg.tensors(images, coef), rgb, strict=True))


class _Scan:
    """One scan as strings of bits, written coefficient by coefficient."""

    def __init__(self, codes):
        self.codes, self.out, self.run, self.held = codes, [], 0, []

    def bits(self, value, n):
        if n:
            self.out.append(format(value, f"0{n}b"))

    def sized(self, v, high_nibble=0):
        s = abs(v).bit_length()
        self.out.append(self.codes[high_nibble << 4 | s])
        self.bits(v if v > 0 else v + (1 << s) - 1, s)

    def flush(self):
        if self.run:
            n = self.run.bit_length() - 1
            self.out.append(self.codes[n << 4])
            self.bits(self.run - (1 << n), n)
            self.out += self.held
        self.run, self.held = 0, []

    def first(self, band, low):
        zeros = 0
        for v in band:
            v = (abs(v) >> low) * (1 if v > 0 else -1)
            if not v:
                zeros += 1
                continue
            self.flush()
            while zeros > 15:
                self.out.append(self.codes[0xF0])
                zeros -= 16
            self.sized(v, zeros)
            zeros = 0
        self.run += zeros > 0

    def refine(self, band, low):
        size = [abs(v) >> low for v in band]
        final = max((k for k, v in enumerate(size) if v == 1), default=-1)
        zeros, mine = 0, []
        for k, (v, s) in enumerate(zip(band, size, strict=True)):
            if not s:
                zeros += 1
                continue
            while zeros > 15 and k <= final:
                self.flush()
                self.out += [self.codes[0xF0], *mine]
                zeros, mine = zeros - 16, []
            if s > 1:
                mine.append(str(s & 1))
                continue
            self.flush()
            self.out += [self.codes[zeros << 4 | 1], str(int(v > 0)), *mine]
            zeros, mine = 0, []
        if zeros or mine:
            self.run += 1
            self.held += mine

    def data(self):
        self.flush()
        bits = "".join(self.out)
        bits += "1" * (-len(bits) % 8)
        return int(bits or "0", 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")


def _table(rng, symbols):
    """A Huffman code in which a few symbols are short: codes, and its body in the file."""
    symbols = rng.sample(symbols, len(symbols))
    few, long = (3, 10) if len(symbols) > 100 else (2, 6)
    counts = [0] * 16
    counts[1 if few == 2 else 2], counts[long - 1] = few, len(symbols) - few
    codes, code, at = {}, 0, 0
    for n, c in enumerate(counts, 1):
        for _ in range(c):
            codes[symbols[at]] = format(code, f"0{n}b")
            code, at = code + 1, at + 1
        code <<= 1
    return codes, bytes(counts) + bytes(symbols)


@pytest.mark.parametrize(("factors", "width", "height"), [([(1, 1)], 21, 10), ([(1, 1)] * 3, 17, 33), ([(2, 2), (1, 1), (1, 1)], 37, 29), ([(2, 1), (1, 1), (1, 1)], 40, 9)])
@pytest.mark.parametrize("seed", range(3))
def test_files_of_another_encoder(factors, width, height, seed):
    """Grey, 4:4:4, 4:2:0 and 4:2:2 images of sizes that are no multiples, runs of ended blocks, other scripts and tables, no restarts."""
    rng = random.Random(seed)
    hmax, vmax = max(f[0] for f in factors), max(f[1] for f in factors)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    blocks, own = [], []
    for h, v in factors:
        grid = [[[0] * 64 for _ in range(across * h)] for _ in range(down * v)]
        there = (-(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8))
        for y, row in enumerate(grid):
            for x, b in enumerate(row):
                b[0] = rng.randint(-900, 900)
                if x < there[0] and y < there[1] and rng.random() < 0.7:
                    for k in rng.sample(range(1, 64), rng.choice([1, 3, 50])):
                        b[k] = rng.choice([-1, 1]) * rng.randint(0, rng.choice([1, 3, 40, 500]))
        blocks.append(grid)
        own.append(there)
    dc, dc_body = _table(rng, list(range(12)))
    ac, ac_body = _table(rng, list(range(256)))

    def segment(marker, body):
        return bytes([255, marker]) + (len(body) + 2).to_bytes(2, "big") + body

    quant = [rng.randint(1, 20) for _ in range(64)]
    out = b"\xff\xd8" + segment(0xDB, b"\x00" + bytes(quant)) + segment(0xC2, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(factors)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors)))
    out += segment(0xC4, b"\x01" + dc_body) + segment(0xC4, b"\x12" + ac_body)
    everything = list(range(len(factors)))
    script = [(everything, 0, 0, 0, 1)] + [([c], a, b, high, low) for a, b, high, low in [(1, 5, 0, 2), (6, 63, 0, 2), (1, 63, 2, 1), (1, 63, 1, 0)] for c in everything] + [(everything, 0, 0, 1, 0)]
    for comps, ss, se, high, low in script:
        s = _Scan(dc if ss == 0 else ac)
        if ss:
            c = comps[0]
            for y in range(own[c][1]):
                for x in range(own[c][0]):
                    (s.refine if high else s.first)(blocks[c][y][x][ss : se + 1], low)
        else:
            last = [0] * 3
            one = len(comps) == 1
            for m in range(across * down):
                for c in comps:
                    h, v = (1, 1) if one else factors[c]
                    for j in range(v):
                        for i in range(h):
                            value = blocks[c][m // across * v + j][m % across * h + i][0]
                            if high:
                                s.bits(value >> low & 1, 1)
                            else:
                                s.sized((value >> low) - last[c])
                                last[c] = value >> low
        out += segment(0xDA, bytes([len(comps)]) + b"".join(bytes([c + 1, 0x12]) for c in comps) + bytes([ss, se, high << 4 | low])) + s.data()
    images, coef = jpeg.decode([out + b"\xff\xd9"])
    flat = [b for grid in blocks for row in grid for b in row]
    assert coef[0].tolist() == flat
    rgb = jpeg.tensors(images, coef)[0]
    assert rgb.shape == (height, width, 3)
    # The samples of one pixel, by the definition of the inverse transform.
    zigzag = {int(n): z for z, n in enumerate(jpeg.ZIGZAG)}
    for _ in range(5):
        x, y = rng.randrange(width), rng.randrange(height)
        sample = []
        for c, (h, v) in enumerate(factors):
            px, py = x * h // hmax, y * v // vmax
            b = blocks[c][py // 8][px // 8]
            total = 0.0
            for p in range(8):
                for q in range(8):
                    z = zigzag[p * 8 + q]
                    scale = (0.5**0.5 if p == 0 else 1) * (0.5**0.5 if q == 0 else 1) / 4
                    total += scale * b[z] * quant[z] * np.cos((2 * (py % 8) + 1) * p * np.pi / 16) * np.cos((2 * (px % 8) + 1) * q * np.pi / 16)
            sample.append(min(255.0, max(0.0, total + 128)))
        if len(sample) == 1:
            want = sample * 3
        else:
            lum, cb, cr = sample[0], sample[1] - 128, sample[2] - 128
            want = [lum + 1.402 * cr, lum - 0.344136 * cb - 0.714136 * cr, lum + 1.772 * cb]
        assert np.abs(rgb[y, x] - np.clip(want, 0, 255)).max() < 2.5


def test_tables_of_media_and_tensors(spark, docs, empty, tmp_path):
    d = docs.select("doc_id", "text")
    media, rgb = jpeg.media_tables(d, str(tmp_path / "a"))
    same = lambda x, *c: sorted(map(str, x.select("doc_id", *c).collect()))
    want = jpeg.round_trip(d, tensor=True)
    assert same(media, "media") == same(want, "media")
    assert same(rgb, "height", "width", "rgb", "payload", "feature") == same(want, "height", "width", "rgb", "payload", "feature")
    assert rgb.filter("length(rgb) != 3 * height * width OR rgb IS NULL").count() == 0
    assert [x.count() for x in jpeg.media_tables(empty.select("doc_id", "text"), str(tmp_path / "b"))] == [0, 0]
    again = spark.read.parquet(str(tmp_path / "a" / "tensors"))
    assert again.count() == docs.count()
