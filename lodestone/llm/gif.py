"""Media columns: GIF streams to timed frames with colour histograms, and lossless byte storage.

The decoder reads LZW code streams of any width and clear policy, applies global or local palettes,
transparency, interlace and disposal, and yields composed frames with their times.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import id_text, slices

#: Width and most rows of a frame when bytes are stored as 8-bit samples.
WIDTH, ROWS = 64, 256
#: Pixels of a screen or frame at most (64 MB as RGBA); larger ones are an error of their stream.
MOST_PIXELS = 1 << 24
#: Bytes of pictures that `media_frames` holds before it passes rows on.
HELD_BYTES = 8 << 20


class Frame(NamedTuple):
    start_ms: int
    delay_ms: int
    left: int
    top: int
    indices: np.ndarray  # the frame's own rectangle, before palette
    canvas: np.ndarray  # composed RGBA picture of the whole screen


def _widths(size: int) -> np.ndarray:
    """Bits of the j-th code after a clear code; the table grows by one with each code but the first."""
    j = np.arange(4100)
    entries = (1 << size) + 2 + np.maximum(0, j - 1)
    return np.clip(np.frexp(entries.astype(float))[1], size + 1, 12).astype(np.int64)


_WIDTHS = {s: _widths(s) for s in range(1, 9)}
_STARTS = {s: np.concatenate([[0], np.cumsum(w)]) for s, w in _WIDTHS.items()}


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """The code stream of `data`, whose values are under 1 << size; the table is cleared when full."""
    clear = 1 << size
    codes, restarts = [clear], []
    if data:
        add = codes.append
        restarts.append(1)
        table: dict[int, int] = {}
        get, nxt, prefix = table.get, clear + 2, data[0]
        for b in memoryview(data)[1:]:
            key = prefix << 8 | b
            code = get(key)
            if code is not None:
                prefix = code
                continue
            add(prefix)
            prefix = b
            if nxt < 4096:
                table[key] = nxt
                nxt += 1
            else:
                add(clear)
                restarts.append(len(codes))
                table.clear()
                nxt = clear + 2
        add(prefix)
    codes.append(clear + 1)
    at = np.arange(len(codes))
    since = at - np.array([0, *restarts])[np.searchsorted(restarts, at, "right")]
    bits = np.unpackbits(np.array(codes, "<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < _WIDTHS[size][since][:, None]], bitorder="little").tobytes()


def flat_encode(data: bytes, size: int = 8) -> bytes:
    """A code stream of single values, cleared before codes would widen: larger, and quick to make and read."""
    step = (1 << size) - 2
    values = np.frombuffer(data, np.uint8).astype(np.uint16)
    codes = np.insert(values, np.arange(0, max(len(values), 1), step), 1 << size)
    codes = np.append(codes, np.uint16((1 << size) + 1))
    bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")[:, : size + 1]
    return np.packbits(bits, bitorder="little").tobytes()


def _flat_decode(stream: bytes, size: int) -> bytes | None:
    """What `lzw_decode` gives for a stream whose codes are single values of one width; None for others."""
    clear, width = 1 << size, size + 1
    n = len(stream) * 8 // width
    raw = np.frombuffer(stream + b"\0\0", np.uint8)
    bit = width * np.arange(n)
    pos = bit >> 3
    codes = (raw[pos].astype(np.uint32) | raw[pos + 1].astype(np.uint32) << np.uint32(8)) >> (bit & 7).astype(np.uint32) & np.uint32(2 * clear - 1)
    marks = np.flatnonzero(codes >= clear)
    stop = np.flatnonzero(codes[marks] != clear)
    if not len(stop) or codes[marks[stop[0]]] != clear + 1:
        return None
    marks = marks[: stop[0] + 1]
    if (np.diff(marks, prepend=-1) > clear - 1).any():
        return None
    codes = codes[: marks[-1]]
    return codes[codes < clear].astype(np.uint8).tobytes()


def _expand(codes: list[int], table: list[bytes], prev: bytes | None, clear: int) -> list[bytes]:
    """The entries of codes between two clear codes; the table grows with each but the first, up to 4096."""
    if not codes:
        return []
    rest = iter(codes)
    out = []
    add = out.append
    if prev is None:
        code = next(rest)
        if code >= clear:
            raise ValueError("a stream begins with a code that is not in the table")
        prev = table[code]
        add(prev)
    grow, size = table.append, len(table)
    for code in rest:
        if code < size:
            entry = table[code]
        elif code == size < 4096:
            entry = prev + prev[:1]
        else:
            raise ValueError("a code is not in the table")
        add(entry)
        if size < 4096:
            grow(prev + entry[:1])
            size += 1
        prev = entry
    return out


def lzw_decode(stream: bytes, size: int, most: int) -> bytes:
    """The bytes of a code stream, `most` at most; a stream that breaks off gives what it holds."""
    if (flat := _flat_decode(stream, size)) is not None:
        return flat[:most]
    clear, end = 1 << size, (1 << size) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8)
    total, at, out, have = len(stream) * 8, 0, [], 0
    singles = [bytes([v]) for v in range(clear)] + [b"", b""]
    done = False
    while not done and have < most:
        # codes up to the next clear or end code; beyond the full table all have 12 bits
        table, prev, first = list(singles), b"", True
        starts = at + _STARTS[size][:-1]
        widths = _WIDTHS[size]
        while True:
            usable = int(np.searchsorted(starts + widths, total, "right"))
            bit = starts[:usable]
            pos = bit >> 3
            word = raw[pos].astype(np.uint32) | raw[pos + 1].astype(np.uint32) << np.uint32(8) | raw[pos + 2].astype(np.uint32) << np.uint32(16)
            codes = word >> (bit & 7).astype(np.uint32) & ((np.uint32(1) << widths[:usable].astype(np.uint32)) - np.uint32(1))
            stop = np.flatnonzero((codes == clear) | (codes == end))
            n = int(stop[0]) if len(stop) else usable
            pieces = _expand(codes[:n].tolist(), table, prev if not first else None, clear)
            if pieces:
                prev, first = pieces[-1], False
            out += pieces
            have += sum(map(len, pieces))
            if len(stop):
                at = int(starts[n] + widths[n])
                done = codes[n] == end
                break
            if usable < len(starts) or have >= most:
                done = True
                break
            starts = starts[-1] + widths[-1] + 12 * np.arange(4096)
            widths = np.full(4096, 12, np.int64)
    return b"".join(out)[:most]


def encode(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay_cs: int = 4, compress: bool = True) -> bytes:
    """Bytes as the grey samples of an animated GIF; their number is a positive multiple of `width`."""
    if not payload or len(payload) % width:
        raise ValueError("the payload is a positive multiple of the width")
    tall = min(rows, len(payload) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, tall, 0xF7, 0, 0), bytes(v for i in range(256) for v in (i, i, i))]
    for at in range(0, len(payload), width * rows):
        part = payload[at : at + width * rows]
        stream = lzw_encode(part) if compress else flat_encode(part)
        out += [b"\x21\xf9\x04\x04", struct.pack("<H", delay_cs), b"\0\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08"]
        out += [x for k in range(0, len(stream), 255) for x in (bytes([len(stream[k : k + 255])]), stream[k : k + 255])]
        out.append(b"\0")
    out.append(b"\x3b")
    return b"".join(out)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def frames(data: bytes, most_pixels: int = MOST_PIXELS) -> Iterator[Frame]:
    """The composed frames of a GIF in order; ValueError, IndexError or struct.error where the stream is broken."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    wide, tall, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    at, shared = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
    if wide * tall > most_pixels:
        raise ValueError("the screen has too many pixels")
    canvas = np.zeros((tall, wide, 4), np.uint8)
    time = 0
    disposal, delay, clear_index = 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, struct.unpack("<H", body[1:3])[0] * 10
                clear_index = body[3] if body[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, own = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        palette = shared
        if own & 0x80:
            n = 3 << ((own & 7) + 1)
            palette, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
        if palette is None:
            raise ValueError("a frame without a palette")
        size = data[at]
        if not 2 <= size <= 8:
            raise ValueError("a code size outside 2 to 8")
        if w * h > most_pixels:
            raise ValueError("a frame has too many pixels")
        stream, at = _blocks(data, at + 1)
        got = np.frombuffer(lzw_decode(stream, size, w * h), np.uint8)
        pixels = np.zeros(w * h, np.uint8)
        pixels[: len(got)] = got
        pixels = pixels.reshape(h, w)
        if own & 0x40:  # interlaced rows come in four passes
            order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
            straight = np.empty_like(pixels)
            straight[order] = pixels
            pixels = straight
        before = canvas.copy() if disposal == 3 else None
        box = canvas[top : top + h, left : left + w]
        seen = pixels[: box.shape[0], : box.shape[1]]
        table = np.full((256, 4), 255, np.uint8)
        table[len(palette) :, :3] = 0
        table[: len(palette), :3] = palette
        if clear_index is None:
            box[...] = table[seen]
        else:
            shown = seen != clear_index
            box[shown] = table[seen[shown]]
        yield Frame(time, delay, left, top, pixels, canvas.copy())
        time += delay
        if disposal == 2:
            box[...] = 0
        elif disposal == 3:
            canvas = before
        disposal, delay, clear_index = 0, 0, None


def histogram(canvas: np.ndarray, bins: int = 16) -> list[int]:
    """Counts of the opaque pixels' red, green and blue values in `bins` equal bins each."""
    opaque = canvas[canvas[..., 3] > 0][:, :3]
    return [int(x) for c in range(3) for x in np.bincount(opaque[:, c].astype(np.int64) * bins // 256, minlength=bins)]


def media_frames(media: DataFrame, id_col: str, gif_col: str, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """One row per frame of each GIF: id, frame, start_ms, delay_ms, width, height, rgba, colours, error.

    Null media give no rows; a broken stream gives one row with `error` after the frames before it, as do
    screens and frames of more than `most_pixels`.  Repeated rows give repeated rows, null ids rows with a
    null id; an empty table gives none; extra columns are ignored whatever their names.
    """
    kind = "id long, frame int, start_ms long, delay_ms long, width int, height int, rgba binary, colours array<long>, error string"
    names = [x.split()[0] for x in kind.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]

    def pictures(i: int | None, data: bytes) -> Iterator[tuple]:
        k = 0
        try:
            for k, f in enumerate(frames(data, most_pixels), 1):
                yield i, k - 1, f.start_ms, f.delay_ms, f.canvas.shape[1], f.canvas.shape[0], f.canvas.tobytes(), histogram(f.canvas), None
        except (ValueError, LookupError, OverflowError, struct.error) as e:
            yield i, k, *[None] * 6, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names)
        for batch in batches:
            held, size = [], 0
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in pictures(i, data.as_py()):
                    held.append(row)
                    size += len(row[6] or b"") + 64
                    if size > HELD_BYTES:
                        yield made(held)
                        held, size = [], 0
            if held:
                yield made(held)

    return media.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{gif_col}`")).where(F.col(f"`{gif_col}`").isNotNull()).mapInArrow(run, kind)


def store_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False, compress: bool = True) -> DataFrame:
    """Store each text's UTF-8 bytes, zero-padded to a positive multiple of 64, as a GIF and read it back.

    Per row: doc_id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 of what is read back,
    media_bytes, media_sha256, feature (frames, duration and the summed grey histogram), and media
    with `with_media`.  Without `compress` the code stream is flat: larger, quicker.  Null and empty texts are 64 zero bytes;
    repeated rows give repeated rows; a null id stays null; no rows give none; other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for text in part.column(1).to_pylist():
                raw = text.encode()
                media = encode(raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH)), compress=compress)
                got, grey, shown, ms = [], np.zeros(16, np.int64), 0, 0
                for f in frames(media):
                    h = f.indices.shape[0]
                    picture = f.canvas[f.top : f.top + h, f.left : f.left + f.indices.shape[1], 0]
                    got.append(picture.tobytes())
                    grey += np.bincount(picture.ravel() >> 4, minlength=16)
                    shown, ms = shown + 1, f.start_ms + f.delay_ms
                back = b"".join(got)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{shown};{ms};" + ",".join(map(str, grey)), media))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][: 7 + with_media]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"][: 7 + with_media]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[c] for r in rows], t) for c, t in enumerate(types))], ["doc_id", *names])

    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return id_text(docs, id_col, text_col).mapInArrow(run, out + ", media binary" * with_media)
