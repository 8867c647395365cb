import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from lumidoc.llm import media


def test_round_trip_is_lossless():
    rng = np.random.default_rng(1)
    payloads = [media.payload_of(t)[0] for t in (None, "", "a" * 63, "a" * 64, "a" * 65, "ÿ" * 99, "plain text " * 900)]
    payloads += [bytes(rng.integers(0, 256, 64 * n, dtype=np.uint8)) for n in (1, 7, 8191, 8192, 9001)] + [b"\xff" * 6400, bytes(640)]
    files = media.encode(payloads)
    for p, f, found in zip(payloads, files, media.thumbnails(files), strict=True):
        assert f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9"
        assert media.payload_from(found) == p
    assert media.encode([]) == []


def test_payload_over_one_image(monkeypatch):
    monkeypatch.setattr(media, "ROWS_MAX", 3)
    monkeypatch.setattr(media, "COLS_MAX", 128)
    p = bytes(range(256)) * 6
    found = media.thumbnails(media.encode([p, p[:64]]))
    assert len(found[0]) == 4 and media.payload_from(found[0]) == p and media.payload_from(found[1]) == p[:64]


def colour_file(rng, width, height, interval):
    """A 4:2:0 file with AC coefficients, and its luminance DC grid; an encoder by the book, one symbol at a time."""
    lengths = {s: 6 for s in range(12)}
    dc_body, dc = media._canonical(lengths)
    ac_body, ac = media._canonical({0: 2, 0xF0: 5, 0x01: 4, 0x12: 5, 0x33: 6})
    bits, scan, pred = [], b"", [0, 0, 0]
    mw, mh = -(-width // 16), -(-height // 16)
    grid = rng.integers(-100, 100, (mh * 2, mw * 2))

    def put(code, n):
        bits.extend(int(b) for b in f"{code:0{n}b}"[-n:] if n)

    def number(v, size):
        put(v if v >= 0 else v + (1 << size) - 1, size)

    def block(k, value):
        d = int(value) - pred[k]
        pred[k] = int(value)
        put(*dc[abs(d).bit_length()])
        number(d, abs(d).bit_length())
        if rng.random() < 0.5:
            put(*ac[0xF0])
            put(*ac[0x12])
            number(int(rng.choice([-3, -2, 2, 3])), 2)
        put(*ac[0x01])
        number(1, 1)
        put(*ac[0])

    def flush():
        while len(bits) % 8:
            bits.append(1)
        out = bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        bits.clear()
        return out

    for m in range(mw * mh):
        if interval and m and m % interval == 0:
            scan += flush() + bytes([0xFF, 0xD0 + (m // interval - 1) % 8])
            pred[:] = [0, 0, 0]
        r, c = divmod(m, mw)
        for y in (0, 1):
            for x in (0, 1):
                block(0, grid[2 * r + y, 2 * c + x])
        block(1, rng.integers(-50, 50))
        block(2, rng.integers(-50, 50))
    scan += flush()
    s = media._segment
    parts = [
        b"\xff\xd8", s(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), s(0xDB, b"\0" + b"\x05" * 64), s(0xC0, struct.pack(">BHHB", 8, height, width, 3) + b"\1\x22\0\2\x11\0\3\x11\0"),
        s(0xC4, b"\0" + dc_body + b"\x10" + ac_body), s(0xDD, struct.pack(">H", interval)) if interval else b"", s(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0"), scan, b"\xff\xd9",
    ]
    return b"".join(parts), np.clip((grid * 5 + 4) // 8 + 128, 0, 255)[: -(-height // 8), : -(-width // 8)]


@pytest.mark.parametrize("interval", [0, 3])
def test_reads_colour_files_of_others(interval):
    rng = np.random.default_rng(9)
    made = [colour_file(rng, w, h, interval) for w, h in ((16, 16), (70, 41), (33, 90))]
    for (_, want), found in zip(made, media.thumbnails([f for f, _ in made]), strict=True):
        assert (found[0][1] == want).all()


def test_bad_files_are_told_and_spoil_no_others():
    good = media.encode([b"x" * 640])[0]
    cut, flipped = good[:-20], bytearray(good)
    flipped[-40] ^= 0x55
    found = media.thumbnails([good, cut, b"", b"no file", bytes(flipped), good.replace(b"\xff\xc0", b"\xff\xc2")])
    assert media.payload_from(found[0]) == b"x" * 640
    assert all(isinstance(found[k], media.BadMedia) for k in (1, 2, 3, 5))
    assert isinstance(found[4], media.BadMedia) or media.payload_from(found[4]) != b"x" * 640


def test_query_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b"), (5, "é" * 32), (6, "long " * 200_000)] + [(k, "".join(rnd.choice("abc xyzé\n") for _ in range(rnd.randint(1, 3000)))) for k in range(10, 40)]
    df = spark.createDataFrame([(*r, b"m") for r in rows], "doc_id long, text string, media binary")
    got = media.read_media(media.with_media(df)).collect()
    assert len(got) == len(rows)
    stored = {}
    for r in got:
        stored.setdefault((r.payload_sha256, r.n_bytes), set()).add((r.media_sha256, r.thumb_hash, r.media_bytes))
    assert all(len(v) == 1 for v in stored.values())
    want = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=str) == sorted(want, key=str)
    assert all(r.error is None for r in got)
    assert media.read_media(media.with_media(df.limit(0))).count() == 0
