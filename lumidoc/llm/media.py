"""Media columns: payloads stored losslessly as baseline JPEG files, and a reader of such files.

Writer. One payload byte is one 8x8 block of a grey baseline JPEG whose only coefficient is the block's mean
(quantised by 8, so that the mean is exact): the file's DC-only thumbnail is the payload. Blocks are laid out 64 to
a row (more where the height would pass 65,535), with a restart marker after each 64 blocks; a comment marker
holds the payload's length, and a payload that doesn't fit one image goes on in a further one.

Reader. Parses markers, Huffman-decodes the scans of baseline files (any sampling and number of components, with
AC coefficients skipped over) and rebuilds the luminance thumbnail from the DC coefficients. Restart intervals of
files with equal tables are decoded in step, one numpy lane to each interval.

Cases: a null text counts as an empty one, whose payload is 64 zero bytes. Equal texts give equal values. Empty
table: empty result. Ids may be null or repeat; they are carried along.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, pieces

UNIT = 64
ROWS_MAX = 65535 // 8
COLS_MAX = 65535 // 8 // UNIT * UNIT
#: Bytes of payload that a worker encodes or decodes at once, longer payloads by themselves.
WORK = 2_000_000

#: Lengths of the Huffman codes of DC categories 0 to 8, fixed: text mostly differs by categories 3 to 7.
DC_LENGTHS = {0: 4, 1: 5, 2: 4, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3, 8: 5}


class BadMedia(ValueError):
    """The bytes aren't a baseline JPEG that can be read."""


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes with zeros up to a positive multiple of 64, and their number without the zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def _canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """A DHT body (counts by length, then symbols) and symbol -> (code, length)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(1 for s in order if lengths[s] == n) for n in range(1, 17)]
    codes, code, at = {}, 0, 0
    for s in order:
        code <<= lengths[s] - at
        at = lengths[s]
        codes[s] = (code, at)
        code += 1
    return bytes(counts) + bytes(order), codes


_DC_BODY, _DC_CODES = _canonical(DC_LENGTHS)
_AC_BODY, _AC_CODES = _canonical({0: 1})  # end of block, one bit


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """For each difference from -255 to 255: its bits with the end-of-block bit, and their number."""
    bits, sizes = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = _DC_CODES[size]
        low = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255], sizes[d + 255] = ((code << size | low) << 1) | _AC_CODES[0][0], n + size + 1
    return bits, sizes


_SYMBOL, _SYMBOL_BITS = _symbols()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(cols: int, rows: int, length: int) -> bytes:
    return b"".join((
        b"\xff\xd8",
        _segment(0xFE, b"payload %d" % length),
        _segment(0xDB, b"\0" + b"\x08" * 64),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, cols * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\x00" + _DC_BODY),
        _segment(0xC4, b"\x10" + _AC_BODY),
        _segment(0xDD, struct.pack(">H", UNIT)),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


def _images(payload: bytes) -> list[tuple[int, int, int, bytes]]:
    """(cols, rows, payload bytes, samples with the last row filled up) of each image that holds a part."""
    out = []
    for at in range(0, len(payload), COLS_MAX * ROWS_MAX):
        part = payload[at : at + COLS_MAX * ROWS_MAX]
        cols = UNIT * -(-len(part) // (UNIT * ROWS_MAX))
        rows = -(-len(part) // cols)
        out.append((cols, rows, len(part), part + bytes(cols * rows - len(part))))
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """The media bytes of each payload."""
    images = [(k, *x) for k, p in enumerate(payloads) for x in _images(p)]
    if not images:
        return []
    samples = np.frombuffer(b"".join(x[4] for x in images), np.uint8).reshape(-1, UNIT).astype(np.int16) - 128
    diff = samples.copy()
    diff[:, 1:] -= samples[:, :-1]
    index = diff + 255
    bits, sizes = _SYMBOL[index], _SYMBOL_BITS[index]
    ends = np.cumsum(sizes, axis=1)
    row_bytes = (ends[:, -1] + 7) // 8
    row_start = np.cumsum(row_bytes) - row_bytes
    at = (ends - sizes + row_start[:, None] * 8).ravel()
    byte, spot = at >> 3, at & 7
    wide = bits.ravel() << (24 - spot - sizes.ravel())  # at most 14 bits from bit 7 on: three bytes hold them
    total = int(row_bytes.sum())
    body = sum(np.bincount(byte + k, weights=(wide >> (16 - 8 * k)) & 255, minlength=total + 2) for k in range(3))[:total].astype(np.int64)
    last = row_start + row_bytes - 1
    body[last] += (1 << (row_bytes * 8 - ends[:, -1])) - 1  # a segment's last byte is filled with ones
    rows = np.array([x[2] * x[1] // UNIT for x in images])
    first = np.cumsum(rows) - rows
    extra = (body == 255).astype(np.int64)
    stuffed = extra.copy()
    marked = np.ones(len(last), bool)
    marked[first + rows - 1] = False
    extra[last[marked]] += 2
    place = np.arange(total) + np.cumsum(extra) - extra
    out = np.zeros(total + int(extra.sum()), np.uint8)
    out[place] = body
    number = np.arange(len(last)) - np.repeat(first, rows)
    spot = place[last] + 1 + stuffed[last]
    out[spot[marked]] = 0xFF
    out[spot[marked] + 1] = 0xD0 + number[marked] % 8
    scan, begin = out.tobytes(), np.r_[place[row_start[first]], len(out)]
    files: list[list[bytes]] = [[] for _ in payloads]
    for n, (k, cols, height, length, _) in enumerate(images):
        files[k] += [_header(cols, height, length), scan[begin[n] : begin[n + 1]], b"\xff\xd9"]
    return [b"".join(x) for x in files]


class Image:
    """One image of a file, as its markers tell."""

    def __init__(self) -> None:
        self.width = self.height = self.interval = 0
        self.length: int | None = None
        self.parts: list[tuple[int, int, int, int]] = []  # id, horizontal and vertical sampling, quantisation table
        self.quant: dict[int, int] = {}
        self.tables: dict[tuple[int, int], bytes] = {}
        self.scan_parts: list[tuple[int, int, int]] = []
        self.scan = b""

    def key(self) -> tuple:
        return (tuple(self.parts), tuple(sorted(self.tables.items())), tuple(self.scan_parts), self.interval)


def parse(data: bytes) -> list[Image]:
    """The images of a file, in order. Raises BadMedia where the markers don't hold together."""
    images: list[Image] = []
    at, image = 0, None
    while at < len(data):
        if data[at] != 0xFF or at + 1 >= len(data):
            raise BadMedia(f"no marker at byte {at}")
        marker = data[at + 1]
        at += 2
        if marker == 0xD8:
            image = Image()
            continue
        if marker == 0xFF:
            at -= 1
            continue
        if image is None:
            raise BadMedia("no start of image")
        if marker == 0xD9:
            images.append(image)
            image = None
            continue
        size = int.from_bytes(data[at : at + 2], "big")
        body, at = data[at + 2 : at + size], at + size
        if size < 2 or at > len(data):
            raise BadMedia("a segment goes past the end")
        try:
            if marker == 0xFE and body.startswith(b"payload "):
                image.length = int(body[8:])
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    image.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    image.tables[body[0] >> 4, body[0] & 15] = body[1:n]
                    body = body[n:]
            elif marker == 0xC0:
                depth, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
                if depth != 8:
                    raise BadMedia("not 8 bits a sample")
                image.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif 0xC1 <= marker <= 0xCF:
                raise BadMedia("not a baseline file")
            elif marker == 0xDD:
                image.interval = int.from_bytes(body, "big")
            elif marker == 0xDA:
                image.scan_parts = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                end = at
                while True:
                    end = data.find(b"\xff", end)
                    if end < 0 or end + 1 >= len(data):
                        raise BadMedia("the scan doesn't end")
                    if data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7:
                        break
                    end += 2
                if [x[0] for x in image.parts] != [x[0] for x in image.scan_parts]:
                    raise BadMedia("more than one scan")
                image.scan, at = data[at:end], end
        except (IndexError, struct.error, ValueError) as e:
            raise BadMedia(str(e)) from e
    if image is not None or not images:
        raise BadMedia("no end of image")
    return images


def _lookup(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each possible 16 bits; length 0 where no code fits."""
    symbol, length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code, at, k = 0, 0, 16
    for n in range(1, 17):
        code <<= n - at
        at = n
        for _ in range(body[n - 1]):
            low, high = code << (16 - n), (code + 1) << (16 - n)
            symbol[low:high], length[low:high] = body[k], n
            code, k = code + 1, k + 1
    return symbol, length


def _intervals(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All entropy-coded bytes without stuffing and markers; each interval's first and last byte, and its scan."""
    sizes = np.array([len(s) for s in scans])
    raw = np.frombuffer(b"".join(s + b"\xff\xd0" for s in scans), np.uint8)
    close = np.cumsum(sizes + 2) - 2  # here a marker was put behind each scan
    after = np.r_[raw[1:], np.uint8(0)]
    lead = raw == 255
    mark = lead & (after >= 0xD0) & (after <= 0xD7)
    drop = mark.copy()
    drop[1:] |= mark[:-1] | (lead[:-1] & (raw[1:] == 0))
    ends_raw = np.flatnonzero(mark)
    kept = np.cumsum(~drop)
    ends = kept[ends_raw]
    starts = np.r_[0, ends[:-1]]
    return raw[~drop], starts, ends, np.searchsorted(close, ends_raw)


def _blocks(image: Image) -> tuple[list[int], int, int]:
    """The components of one MCU's blocks in order, and the MCUs across and down."""
    if len(image.parts) == 1:
        return [0], -(-image.width // 8), -(-image.height // 8)
    wide, high = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
    return [k for k, p in enumerate(image.parts) for _ in range(p[1] * p[2])], -(-image.width // (8 * wide)), -(-image.height // (8 * high))


def _decode_scans(images: list[Image]) -> list[list[np.ndarray]]:
    """For each image the DC coefficients (not yet dequantised) of each component, in scan order.

    The images must agree in tables, components and restart interval.
    """
    one = images[0]
    data, starts, ends, of = _intervals([x.scan for x in images])
    data = np.r_[data, np.full(8, 255, np.uint8)].astype(np.uint32)
    order, _, _ = _blocks(one)
    mcus = np.array([w * h for _, w, h in map(_blocks, images)])
    number = np.arange(len(of)) - np.searchsorted(of, of)
    need = np.minimum(one.interval, mcus[of] - number * one.interval) if one.interval else mcus[of]
    if (need <= 0).any() or (np.bincount(of, need, minlength=len(images)) != mcus).any():
        raise BadMedia("intervals are missing")
    try:
        dc = [_lookup(one.tables[0, p[1]]) for p in one.scan_parts]
        ac = [_lookup(one.tables[1, p[2]]) for p in one.scan_parts]
    except KeyError as e:
        raise BadMedia("a table is missing") from e
    bit, limit = starts.astype(np.int64) * 8, ends.astype(np.int64) * 8
    pred = np.zeros((len(one.parts), len(of)), np.int64)
    most = int(need.max())
    per = [order.count(k) for k in range(len(one.parts))]
    out = [np.zeros((len(of), most, n), np.int32) for n in per]

    def window(at: np.ndarray) -> np.ndarray:
        k = at >> 3
        k = np.minimum(k, len(data) - 4)
        return ((data[k] << 24 | data[k + 1] << 16 | data[k + 2] << 8 | data[k + 3]) << (at & 7).astype(np.uint32)) >> np.uint32(8)  # 24 bits, of which 17 at least hold

    def magnitude(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        value = (window(at).astype(np.int64) & 0xFFFFFF) >> (24 - size)
        return np.where((size > 0) & (value < (1 << size >> 1)), value - (1 << size) + 1, value)

    every = np.arange(len(of))
    for step in range(most):
        lanes = every if step < int(need.min()) else np.flatnonzero(need > step)
        seen = [0] * len(one.parts)
        for part in order:
            at = bit[lanes]
            symbol, length = (t[window(at) >> 8 & 0xFFFF] for t in dc[part])
            if not length.all():
                raise BadMedia("no code fits")
            size = symbol.astype(np.int64)
            if (size > 11).any():
                raise BadMedia("a DC difference is too wide")
            at = at + length
            pred[part, lanes] += magnitude(at, size)
            out[part][lanes, step, seen[part]] = pred[part, lanes]
            seen[part] += 1
            at += size
            k = np.ones(len(lanes), np.int64)
            busy = np.arange(len(lanes))
            while len(busy):
                symbol, length = (t[window(at[busy]) >> 8 & 0xFFFF] for t in ac[part])
                if not length.all():
                    raise BadMedia("no code fits")
                at[busy] += length.astype(np.int64) + (symbol & 15)
                k[busy] = np.where(symbol == 0, 64, k[busy] + (symbol >> 4) + 1)
                if (k[busy] > 64).any():
                    raise BadMedia("a block has too many coefficients")
                busy = busy[k[busy] < 64]
            bit[lanes] = at
    if (bit > limit).any() or (limit - bit >= 8).any():
        raise BadMedia("an interval's length doesn't fit")
    found: list[list[np.ndarray]] = []
    bounds = np.searchsorted(of, np.arange(len(images) + 1))
    for n in range(len(images)):
        a, b = bounds[n], bounds[n + 1]
        full = np.arange(most)[None, :] < need[a:b, None]
        found.append([o[a:b][full] for o in out])
    return found


def thumbnails(files: list[bytes]) -> list[list[tuple[Image, np.ndarray]] | BadMedia]:
    """For each file its images with their luminance thumbnails (uint8, one sample to a block), or what is wrong."""
    out: list = [None] * len(files)
    groups: dict[tuple, list[tuple[int, int, Image]]] = {}
    for n, data in enumerate(files):
        try:
            images = parse(data)
        except BadMedia as e:
            out[n] = e
            continue
        out[n] = [None] * len(images)
        for k, image in enumerate(images):
            groups.setdefault(image.key(), []).append((n, k, image))
    for members in groups.values():
        try:
            decoded = _decode_scans([m[2] for m in members])
        except BadMedia:
            decoded = []
            for m in members:  # one bad file doesn't spoil the others
                try:
                    decoded += _decode_scans([m[2]])
                except BadMedia as e:
                    decoded.append(e)
        for (n, k, image), dc in zip(members, decoded, strict=True):
            if isinstance(out[n], BadMedia):
                continue
            if isinstance(dc, BadMedia):
                out[n] = dc
                continue
            out[n][k] = (image, _luminance(image, dc[0]))
    return out


def _luminance(image: Image, dc: np.ndarray) -> np.ndarray:
    part = image.parts[0]
    across, down = -(-image.width // 8), -(-image.height // 8)
    if len(image.parts) == 1:
        grid = dc.reshape(down, across)
    else:
        _, mw, mh = _blocks(image)
        grid = dc.reshape(mh, mw, part[2], part[1]).transpose(0, 2, 1, 3).reshape(mh * part[2], mw * part[1])[:down, :across]
    q = image.quant.get(part[3], 1)
    return np.clip(np.floor_divide(grid * q + 4, 8) + 128, 0, 255).astype(np.uint8)


def payload_from(images: list[tuple[Image, np.ndarray]]) -> bytes:
    """The stored payload: the thumbnails' samples, without what fills the last row."""
    return b"".join(thumb.tobytes()[: image.length] if image.length is not None else thumb.tobytes() for image, thumb in images)


def average_hash(thumb: np.ndarray) -> str:
    """16 hex digits: 8x8 cell means of the thumbnail against their overall mean."""
    rows = np.linspace(0, thumb.shape[0], 9).astype(int)
    cols = np.linspace(0, thumb.shape[1], 9).astype(int)
    table = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1))
    table[1:, 1:] = thumb.cumsum(0, dtype=np.float64).cumsum(1)
    r0, r1, c0, c1 = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1), cols[:-1], np.maximum(cols[1:], cols[:-1] + 1)
    r0, c0 = np.minimum(r0, thumb.shape[0] - 1), np.minimum(c0, thumb.shape[1] - 1)
    r1, c1 = np.minimum(r1, thumb.shape[0]), np.minimum(c1, thumb.shape[1])
    cells = table[np.ix_(r1, c1)] - table[np.ix_(r0, c1)] - table[np.ix_(r1, c0)] + table[np.ix_(r0, c0)]
    cells = cells / np.outer(r1 - r0, c1 - c0)
    return np.packbits(cells > cells.mean()).tobytes().hex()


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes BIGINT, media BINARY): every text stored as a media file."""
    limit_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", WORK):
            made = [payload_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array(encode([p for p, _ in made]), pa.binary())], names=[id_col, "n_bytes", "media"])

    rows = docs.select(id_col, F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_bytes bigint, media binary")


def read_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read a media column back: dimensions of the first image, a thumbnail hash of each, digests of the payload and of the stored form.

    Files that can't be read get `error` and null features; the rows stay.
    """
    limit_batches(media.sparkSession)
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "images", "thumb_hash", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "media", WORK):
            files = [x or b"" for x in batch.column(2).to_pylist()]
            rows = []
            for data, images in zip(files, thumbnails(files), strict=True):
                stored = (len(data), hashlib.sha256(data).hexdigest())
                if isinstance(images, BadMedia):
                    rows.append((None, None, None, *stored, None, None, None, None, str(images)))
                    continue
                payload = payload_from(images)
                first = images[0][0]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), *stored, first.width, first.height, len(images), ",".join(average_hash(thumb) for _, thumb in images), None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=names)

    rows = media.select(id_col, "n_bytes", "media")
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, width int, height int, images int, thumb_hash string, error string")
