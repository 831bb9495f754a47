import hashlib
import zlib

import numpy as np
import pytest

from trackledger.llm import webp

RNG = np.random.default_rng(7)


# -- a small writer of general streams, for the decoder's sake -----------------------------------


def prefix_parts(value):
    """(symbol, extra bits, extra value) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    extra = (value - 1).bit_length() - 2
    top = (value - 1) >> extra
    return 2 * extra + 2 + (top & 1), extra, (value - 1) & ((1 << extra) - 1)


def write_codes(out, used, alphabet):
    counts = np.bincount(used, minlength=alphabet) if used else np.eye(1, alphabet, dtype=int)[0]
    symbols = np.flatnonzero(counts).tolist()
    lengths = np.zeros(alphabet, np.int64)
    if len(symbols) > 1:
        lengths[symbols] = webp.code_lengths(counts[symbols].tolist())
    webp.put_code(out, symbols, lengths[symbols].tolist(), alphabet)
    codes = webp.canonical(lengths, webp.MAX_BITS)
    return lambda s: out.put(int(codes[s]), int(lengths[s]))


def write_image(out, tokens, cache_bits=0, main=False, groups=None):
    """Tokens: ("lit", argb), ("copy", length, distance code), ("cache", index); ``groups`` is
    (block bits, group image tokens, group of each token)."""
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(1 if groups else 0, 1)
        if groups:
            out.put(groups[0] - 2, 3)
            write_image(out, groups[1])
    of = groups[2] if groups else [0] * len(tokens)
    size = 256 + 24 + (1 << cache_bits if cache_bits else 0)
    writers = []
    for g in range(max(of, default=0) + 1):
        mine = [t for t, o in zip(tokens, of, strict=True) if o == g]
        green = [t[1] >> 8 & 255 if t[0] == "lit" else 256 + prefix_parts(t[1])[0] if t[0] == "copy" else 280 + t[1] for t in mine]
        lits = [t[1] for t in mine if t[0] == "lit"]
        writers.append(
            [write_codes(out, green, size), *[write_codes(out, [p >> s & 255 for p in lits], 256) for s in (16, 0, 24)],
             write_codes(out, [prefix_parts(t[2])[0] for t in mine if t[0] == "copy"], 40)]
        )
    for t, o in zip(tokens, of, strict=True):
        green, red, blue, alpha, distance = writers[o]
        if t[0] == "lit":
            green(t[1] >> 8 & 255), red(t[1] >> 16 & 255), blue(t[1] & 255), alpha(t[1] >> 24 & 255)
        elif t[0] == "copy":
            s, n, v = prefix_parts(t[1])
            green(256 + s)
            out.put(v, n)
            s, n, v = prefix_parts(t[2])
            distance(s)
            out.put(v, n)
        else:
            green(280 + t[1])


def file_of(width, height, transforms, tokens, **kw):
    out = webp.BitText()
    out.put(0x2F, 8), out.put(width - 1, 14), out.put(height - 1, 14), out.put(0, 4)
    for t in transforms:
        out.put(1, 1)
        t(out)
    out.put(0, 1)
    write_image(out, tokens, main=True, **kw)
    data = out.value.to_bytes((out.n + 7) // 8, "little")
    pad = b"\0" * (len(data) & 1)
    return b"RIFF" + (12 + len(data) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + pad


def literal(px):
    """(n, 4) samples red, green, blue, alpha as literal tokens."""
    return [("lit", int(a) << 24 | int(r) << 16 | int(g) << 8 | int(b)) for r, g, b, a in px]


def picture(h, w):
    return RNG.integers(0, 256, (h, w, 4)).astype(np.uint8)


# -- tests ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (17, 4)])
def test_literals(shape):
    px = picture(*shape)
    assert (webp.decode(file_of(shape[1], shape[0], [], literal(px.reshape(-1, 4)))) == px).all()


def test_back_references_and_distance_map():
    px = picture(1, 8)[0]
    tokens = [*literal(px), ("copy", 8, 1), ("copy", 3, 120 + 5), ("copy", 21, 2)]
    got = webp.decode(file_of(8, 5, [], tokens)).reshape(-1, 4)
    want = [tuple(p) for p in px]
    for length, back in ((8, 8), (3, 5), (21, 1)):  # code 1: the pixel above; code 2: the pixel before
        for _ in range(length):
            want.append(want[-back])
    assert [tuple(p) for p in got] == want


def test_distance_map_has_the_known_corner_entries():
    assert webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)]
    assert len(webp.NEAR) == 120 and webp.NEAR[-1] == (8, 7)


@pytest.mark.parametrize("bits", [1, 4, 11])
def test_colour_cache(bits):
    px = RNG.integers(0, 4, (60, 4)).astype(np.uint8)
    cache, tokens = {}, []
    for t in literal(px):
        at = (0x1E35A7BD * t[1] & 0xFFFFFFFF) >> (32 - bits)
        tokens.append(("cache", at) if cache.get(at) == t[1] else t)
        cache[at] = t[1]
    assert any(t[0] == "cache" for t in tokens)
    assert (webp.decode(file_of(10, 6, [], tokens, cache_bits=bits)).reshape(-1, 4) == px).all()


def test_groups_of_codes():
    px = picture(8, 8)
    of = [(y >> 2) * 2 + (x >> 2) for y in range(8) for x in range(8)]
    group_image = [("lit", g << 8) for g in range(4)]
    got = webp.decode(file_of(8, 8, [], literal(px.reshape(-1, 4)), groups=(2, group_image, of)))
    assert (got == px).all()


def test_subtract_green():
    px = picture(4, 6)
    low = px.copy()
    low[..., 0] -= px[..., 1]
    low[..., 2] -= px[..., 1]
    assert (webp.decode(file_of(6, 4, [lambda o: o.put(2, 2)], literal(low.reshape(-1, 4)))) == px).all()


@pytest.mark.parametrize("n", [2, 4, 16, 40])
def test_palette(n):
    colours = picture(1, n)[0]
    index = RNG.integers(0, n, (5, 7))
    delta = np.diff(colours, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
    pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    per, each = 8 >> pack, 1 << pack
    wide = -(-7 // each)
    packed = np.zeros((5, wide), int)
    for y in range(5):
        for x in range(7):
            packed[y, x // each] |= int(index[y, x]) << (x % each * per)

    def transform(o):
        o.put(3, 2), o.put(n - 1, 8)
        write_image(o, literal(delta))

    tokens = [("lit", 0xFF000000 | v << 8) for v in packed.ravel().tolist()]
    assert (webp.decode(file_of(7, 5, [transform], tokens)) == colours[index]).all()


def test_cross_colour():
    px, block = picture(6, 9), picture(2, 3)
    signed = lambda v: int(np.int8(np.uint8(v)))
    low = px.copy()
    for y in range(6):
        for x in range(9):
            r, g, b, _ = (int(v) for v in px[y, x])
            to_blue_red, to_blue, to_red, _ = block[y >> 2, x >> 2]  # red, green, blue samples of the element
            low[y, x, 0] = (r - (signed(to_red) * signed(g) >> 5)) & 255
            low[y, x, 2] = (b - (signed(to_blue) * signed(g) >> 5) - (signed(to_blue_red) * signed(r) >> 5)) & 255

    def transform(o):
        o.put(1, 2), o.put(0, 3)
        write_image(o, literal(block.reshape(-1, 4)))

    assert (webp.decode(file_of(9, 6, [transform], literal(low.reshape(-1, 4)))) == px).all()


def guess(mode, px, y, x):
    """Prediction by the definition of the modes, sample by sample."""
    flat = px.reshape(-1, px.shape[1], 4).astype(int)
    left, top, corner = flat[y, x - 1], flat[y - 1, x], flat[y - 1, x - 1]
    right = flat[y - 1, x + 1] if x + 1 < px.shape[1] else flat[y, 0]
    clamp = lambda v: np.clip(v, 0, 255)
    if mode == 11:
        p = left + top - corner
        return left if abs(p - left).sum() < abs(p - top).sum() else top
    return [
        np.array([0, 0, 0, 255]), left, top, right, corner, ((left + right) // 2 + top) // 2, (left + corner) // 2, (left + top) // 2,
        (corner + top) // 2, (top + right) // 2, ((left + corner) // 2 + (top + right) // 2) // 2, None, clamp(left + top - corner),
        clamp((left + top) // 2 + np.fix(((left + top) // 2 - corner) / 2).astype(int)),
    ][mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    px = picture(5, 6)
    low = np.zeros_like(px)
    for y in range(5):
        for x in range(6):
            if not y and not x:
                p = np.array([0, 0, 0, 255])
            elif not y:
                p = px[y, x - 1].astype(int)
            elif not x:
                p = px[y - 1, x].astype(int)
            else:
                p = guess(mode, px, y, x)
            low[y, x] = (px[y, x].astype(int) - p) & 255

    def transform(o):
        o.put(0, 2), o.put(0, 3)
        write_image(o, [("lit", 0xFF000000 | mode << 8)] * 4)

    assert (webp.decode(file_of(6, 5, [transform], literal(low.reshape(-1, 4)))) == px).all()


def test_transforms_together():
    px = picture(4, 4)
    low = px.copy()
    low[..., 0] -= px[..., 1]
    low[..., 2] -= px[..., 1]
    res = low.copy()
    flat = low.reshape(4, 4, 4)
    for y in range(4):
        for x in range(4):
            p = [0, 0, 0, 255] if not y and not x else flat[y, x - 1] if x and (not y or True) and x > 0 else flat[y - 1, x]
            res[y, x] = flat[y, x] - np.array(p, np.uint8)

    def predictor(o):
        o.put(0, 2), o.put(0, 3)
        write_image(o, [("lit", 0xFF000000 | 1 << 8)])

    # Stream order: subtract green was applied first, so it is listed first and undone last.
    got = webp.decode(file_of(4, 4, [lambda o: o.put(2, 2), predictor], literal(res.reshape(-1, 4))))
    assert (got == px).all()


@pytest.mark.parametrize(
    "text", [None, "", "a", "aa" * 300, "xyz" * 5000, "é漢" * 700, bytes(range(256)).decode("latin1") * 20, "a" * (3 * webp.STRIP)]
)
def test_payload_round_trip_and_both_readers(text):
    raw = (text or "").encode()
    payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    media = webp.store_text(text)
    assert webp.load_payload(media) == payload
    assert webp.file_end(media) == len(media) and webp.decode(media)[:, :, 1].tobytes() == payload
    (row,) = webp.digests([text])
    bins = [sum(b >> 4 == k for b in payload) * 10_000 // len(payload) for k in range(16)]
    assert row[6] == f"rows={len(payload) // 576};mean={sum(payload) * 100 // len(payload)};bins={','.join(map(str, bins))}"
    assert row[:6] == (
        len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(),
    )


def test_skewed_counts_keep_the_length_limit_and_other_files_are_read():
    counts = [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584]
    lengths = webp.code_lengths(counts)
    assert max(lengths) <= webp.MAX_BITS and sum(2.0**-n for n in lengths) == 1.0
    px = picture(3, 5)
    plain = webp.encode_strips([np.zeros(576, np.uint8)])[0]
    a, b = webp.decode_strips([file_of(5, 3, [], literal(px.reshape(-1, 4))), plain])
    assert (a == px[:, :, 1].ravel()).all() and not b.any()


@pytest.mark.parametrize("data", [b"", b"RIFF", b"RIFF\x04\0\0\0WEBP"])
def test_damaged_files_raise(data):
    with pytest.raises(ValueError):
        webp.decode(data)
    whole = webp.store_text("".join(map(chr, RNG.integers(32, 127, 500))))
    with pytest.raises(ValueError):
        webp.decode(whole[: len(whole) // 2])


def test_repeats_are_stored_as_back_references():
    line = "".join(map(chr, RNG.integers(32, 127, 90)))
    text = line + "x" * 40 + line + "y" + line[:50] + "zz" * 5000 + line
    assert len(webp.store_text(text)) < 600
    flat = np.frombuffer(text.encode() + b"\xff" * (-len(text) % 576), np.uint8)[: webp.STRIP]
    both = [flat, flat[:576]]
    start, length, distance = webp.find_repeats(np.concatenate(both), np.array([len(s) for s in both]))
    joined, ends = np.concatenate(both), np.cumsum([len(s) for s in both])
    assert len(start) and (length >= 1).all() and (length <= webp.LONGEST).all() and (start[1:] >= (start + length)[:-1]).all()
    for s, n, d in zip(start, length, distance, strict=True):
        strip = np.searchsorted(ends, s, side="right")
        assert s - d >= (0 if strip == 0 else ends[0]) and s + n <= ends[strip]
        assert all(joined[s + i] == joined[s + i - d] for i in range(n))
    assert [s.tobytes() for s in webp.decode_strips(webp.encode_strips(both))] == [s.tobytes() for s in both]


def kinds(media):
    return [[step[0] for step in webp.Head(image).steps] for _, _, image in webp.images_of(media)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("".join(map(chr, RNG.choice([65, 66], 4000))), [webp.PALETTE]),
        ("".join(map(chr, RNG.choice([65, 66, 67], 4000))), [webp.PALETTE]),
        ("".join(map(chr, RNG.choice(range(48, 58), 9000))), [webp.PALETTE]),
        ("".join(map(chr, np.arange(9000) // 2 % 96 + 31)), [webp.PREDICTOR, webp.SUBTRACT_GREEN]),
        ("".join(map(chr, RNG.integers(32, 127, 5000))), [webp.SUBTRACT_GREEN]),
    ],
)
def test_strips_take_the_transform_that_pays(text, want):
    media = webp.store_text(text)
    assert kinds(media)[0] == want
    payload = text.encode() + b"\xff" * (-len(text) % 576)
    assert webp.load_payload(media) == payload and webp.decode(media)[:, :, 1].tobytes() == payload
    (row,) = webp.digests([text])
    assert row[2] == hashlib.sha256(payload).hexdigest() and row[5] == hashlib.sha256(media).hexdigest()


def test_several_strips_are_frames_of_one_file():
    text = "".join(map(chr, RNG.integers(32, 127, 2 * webp.STRIP + 700)))
    media = webp.store_text(text)
    tags = [t for t, _ in webp.chunks(media, 12, len(media))]
    assert tags == [b"VP8X", b"ANIM", b"ANMF", b"ANMF", b"ANMF"]
    assert [(x, y) for x, y, _ in webp.images_of(media)] == [(0, 0), (0, 16), (0, 32)]


def test_short_repeats_are_back_references_too():
    rng = np.random.default_rng(3)
    word = rng.integers(32, 127, 9).astype(np.uint8)
    flat = np.concatenate([part for _ in range(40) for part in (word, rng.integers(128, 255, 5).astype(np.uint8))])[:540]
    start, length, _ = webp.find_repeats(flat, np.array([len(flat)]))
    assert len(start) >= 30 and length.min() < 16


def test_columns(spark):
    rows = [(1, "one", "m"), (1, "one", "m"), (None, None, None), (2, "", "x"), (3, "long text " * 20_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = webp.media_digests(docs, into="found").collect()
    assert len(got) == 5 and len({r["found"]["payload_sha256"] for r in got}) == 3
    files = webp.media_column(docs.where("doc_id = 1"), into="file")
    px = webp.pixel_column(files, media_col="file").select("pixels.*").collect()
    assert {(r["width"], r["height"], len(r["rgba"])) for r in px} == {(576, 1, 576 * 4)}
    bad = spark.createDataFrame([(b"x",), (None,)], "media binary")
    assert [r["pixels"]["width"] for r in webp.pixel_column(bad).collect()] == [None, None]
    assert webp.media_digests(docs.limit(0), into="found").count() == 0
