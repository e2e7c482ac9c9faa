"""GIF: writing payloads, decoding LZW code streams, composing frames, colour histograms.

``decode`` reads any GIF87a or GIF89a: global and local palettes, interlacing, transparency,
disposal (keep, background, previous), frame delays.  ``encode_samples`` stores bytes losslessly as
8-bit palette indexes: timed frames of 64 by 256 samples at most, each cleared before the next, a palette of
256 colours (three bits of red and green, two of blue), and LZW code streams with a full dictionary.

Cases: a null text is the empty text (64 zero bytes); equal texts give equal values; repeated rows
stay; a null or broken file, or one whose images are beyond ``MAX_PIXELS``, has null columns; an empty
table gives no rows; other columns are kept, those named as a result are replaced; a very long text is
stored whole, in as many frames as it takes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import append_columns

WIDTH = 64
HEIGHT = 256
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)
_I = np.arange(256)
COLOURS = np.column_stack([(_I >> 5) * 255 // 7, (_I >> 2 & 7) * 255 // 7, (_I & 3) * 255 // 3]).astype(np.uint8)
CLEAR, END, FULL = 256, 257, 4096
MAX_PIXELS = 1 << 26  #: of an image or a canvas that is drawn
BINS = 64  #: of a colour histogram: two bits of each channel
#: Bits of the codes between two clear codes: the n-th comes when the decoder's table has 256 + n entries, one less before it has two codes.
CODE_BITS = np.array([max(9, (256 + n).bit_length()) for n in range(1, FULL - 255)])
CODE_BITS[0] = 9


@dataclass
class Frame:
    """One stored image: its place, samples (palette indexes), palette and control values."""

    left: int
    top: int
    width: int
    height: int
    samples: np.ndarray
    palette: np.ndarray
    delay: int = 0
    disposal: int = 0
    transparent: int | None = None


@dataclass
class Gif:
    width: int
    height: int
    background: int
    palette: np.ndarray | None
    frames: list[Frame]


def _blocks(data: bytes) -> bytes:
    """Data cut into sub-blocks of at most 255 bytes, with the terminator."""
    whole = len(data) // 255
    rows = np.empty((whole, 256), np.uint8)
    rows[:, 0] = 255
    rows[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return rows.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def lzw_encode(samples: bytes) -> bytes:
    """A code stream of 8-bit samples: the longest known run each time, the dictionary begun anew when it is full."""
    # a run with one more sample is its code times 256 and that sample; ``longer`` has that run's own code times 256
    longer: dict[int, int] = {}
    rows: list[list[int]] = []
    node, size, row = samples[0] << 8, END + 1 << 8, []
    put, full = row.append, FULL << 8
    for c in samples[1:]:
        key = node + c
        if key in longer:
            node = longer[key]
            continue
        put(key)
        longer[key] = size
        size += 256
        node = c << 8
        if size == full:
            rows.append(row)
            longer, row, size = {}, [], END + 1 << 8
            put = row.append
    rows.append(row)
    parts, width = [[CLEAR]], [[9]]
    for i, row in enumerate(rows):
        last = i == len(rows) - 1
        codes = [*(np.array(row, np.int64) >> 8), *([node >> 8, END] if last else [CLEAR])]
        parts.append(codes)
        width.append(CODE_BITS[: len(codes)])
    codes, width = np.concatenate(parts).astype("<u2"), np.concatenate(width)
    bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little", count=12)
    return np.packbits(bits[np.arange(12) < width[:, None]], bitorder="little").tobytes()


def encode_samples(payload: bytes, delay: int = 10) -> bytes:
    """A GIF whose frames hold the payload as samples; its length must be a multiple of 64."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    most = WIDTH * HEIGHT
    parts = [payload[i : i + most] for i in range(0, len(payload), most)]
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, len(parts[0]) // WIDTH, 0xF7, 0, 0), COLOURS.tobytes()]
    for part in parts:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 2 << 2, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        out.append(_blocks(lzw_encode(part)))
    return b"".join(out) + b"\x3b"


def _codes(bits: np.ndarray, at: int, width: int, count: int) -> np.ndarray:
    """Up to ``count`` codes of ``width`` bits that begin at bit ``at``."""
    count = min(count, (len(bits) - at) // width)
    part = bits[at : at + count * width].reshape(count, width)
    packed = np.packbits(part, axis=1, bitorder="little")
    return packed[:, 0].astype(np.int32) if width <= 8 else packed[:, 0] + (packed[:, 1].astype(np.int32) << 8)


def lzw_decode(data: bytes, min_bits: int, count: int) -> np.ndarray:
    """``count`` samples of a code stream; too short a stream leaves zeros behind."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    found = np.frombuffer(_lzw_samples(bits, min_bits, count), np.uint8)
    out = np.zeros(count, np.uint8)
    out[: min(count, len(found))] = found[:count]
    return out


def _lzw_samples(bits: np.ndarray, min_bits: int, count: int) -> bytes:
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    out, at, done, ended = [], 0, 0, False
    while done < count and not ended:  # codes up to a clear code
        parts, n, width, cleared = [], 0, min_bits + 1, False
        while not cleared and not ended:
            # the table has end + n entries when the n-th code has been read; it is widened as it reaches a power of two
            room = (1 << width) - end - n if width < 12 else 1 << 14
            codes = _codes(bits, at, width, max(1, room))
            if not len(codes):
                ended = True
                break
            signs = np.flatnonzero((codes == clear) | (codes == end))
            stop = int(signs[0]) if len(signs) else len(codes)
            parts.append(codes[:stop])
            n += stop
            at += width * (stop + (stop < len(codes)))
            if stop < len(codes):
                cleared, ended = codes[stop] == clear, codes[stop] == end
            elif width < 12:
                width += 1
        codes = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        found, whole = _expanded(codes, clear)
        out.append(found)
        done += len(found)
        ended = ended or not whole
    return np.concatenate(out).tobytes() if out else b""


def _expanded(codes: np.ndarray, clear: int) -> tuple[np.ndarray, bool]:
    """The samples of the codes between two clear codes, and whether all of them are known.

    The table's entry number e is what the e-th code stands for and the sample behind it, so a code's
    samples are those that begin where the e-th code's do.  Lengths and samples are found by following
    such references in doubling steps.
    """
    index = np.arange(len(codes))
    root = codes < clear
    e = np.where(root, index, codes - clear - 2)
    bad = np.flatnonzero(~root & ((e >= index) | (e < 0)))
    if len(bad):
        codes, index, root, e = (x[: bad[0]] for x in (codes, index, root, e))
    length, to = (~root).astype(np.int64), e
    while length[to].any():
        length, to = length + length[to], to[to]
    length += 1
    start = np.cumsum(length) - length
    n = int(length.sum())
    source = np.arange(n) + np.repeat(start[e] - start, length)
    while len(source) and (source != (further := source[source])).any():
        source = further
    samples = np.zeros(n, np.uint8)
    samples[start[root]] = codes[root]
    return samples[source], not len(bad)


def _deinterlace(samples: np.ndarray) -> np.ndarray:
    height = len(samples)
    order = np.concatenate([np.arange(a, height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
    out = np.empty_like(samples)
    out[order] = samples
    return out


def decode(data: bytes) -> Gif:
    """Frames of a GIF as stored (before disposal)."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, packed, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, palette = 13, None
    if packed & 0x80:
        n = 2 << (packed & 7)
        palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    frames: list[Frame] = []
    control = (0, 0, None)

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, after = sub_blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                flags, delay, index = struct.unpack_from("<BHB", body)
                control = (delay, flags >> 2 & 7, index if flags & 1 else None)
            at = after
        elif data[at] == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            colours = palette
            if flags & 0x80:
                n = 2 << (flags & 7)
                colours = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
                at += 3 * n
            min_bits = data[at]
            if w * h > MAX_PIXELS or not 1 <= min_bits <= 8:
                raise ValueError("the image is too large or its codes are")
            body, at = sub_blocks(at + 1)
            samples = lzw_decode(body, min_bits, w * h).reshape(h, w)
            samples = _deinterlace(samples) if flags & 0x40 else samples
            frames.append(Frame(left, top, w, h, samples, GREY if colours is None else colours, *control))
            control = (0, 0, None)
        else:
            break
    return Gif(width, height, background, palette, frames)


def compose(gif: Gif):
    """(delay, canvas) of each frame in turn: red, green, blue, alpha, after transparency and disposal."""
    height = max([gif.height] + [f.top + f.height for f in gif.frames])
    width = max([gif.width] + [f.left + f.width for f in gif.frames])
    if height * width > MAX_PIXELS:
        raise ValueError("the canvas is too large")
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in gif.frames:
        before = canvas.copy() if f.disposal == 3 else None
        part = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        rgba = np.zeros((256, 4), np.uint8)
        rgba[: len(f.palette), :3] = f.palette
        rgba[:, 3] = 255
        if f.transparent is None:
            part[:] = rgba[f.samples]
        else:
            shown = f.samples != f.transparent
            part[shown] = rgba[f.samples[shown]]
        yield f.delay, canvas.copy()
        if f.disposal == 2:
            part[:] = 0
        elif before is not None:
            canvas = before


def colours(canvas: np.ndarray) -> np.ndarray:
    """Pixels of a canvas by colour, two bits of red, green and blue; transparent ones count nowhere."""
    bins = (canvas[..., 0] >> 6 << 4) | (canvas[..., 1] >> 6 << 2) | (canvas[..., 2] >> 6)
    seen = canvas[..., 3] > 0
    return np.bincount(bins.reshape(-1) if seen.all() else bins[seen], minlength=BINS)


def histogram(gif: Gif) -> list[tuple[int, np.ndarray]]:
    """(delay, pixels by colour) of each frame as it is shown."""
    return [(delay, colours(canvas)) for delay, canvas in compose(gif)]


def feature(gif: Gif, shown: list[tuple[int, np.ndarray]]) -> str:
    """Size, frames, their time and the colour histogram over all of them, as one line."""
    total = np.sum([h for _, h in shown], axis=0) if shown else np.zeros(BINS, int)
    return f"{gif.width}x{gif.height};frames={len(shown)};ms={10 * sum(d for d, _ in shown)};rgb=" + ",".join(map(str, total.tolist()))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes filled with zeros to a positive multiple of 64, and the length before that."""
    raw = (text or "").encode()
    return raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


FIELDS = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("n_frames", T.LongType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("colours", T.ArrayType(T.LongType())),
]


def store_texts(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, with_media: bool = False) -> DataFrame:
    """Stores each text as a GIF, reads it back and adds digests and features (and ``media``)."""
    fields = FIELDS + [T.StructField("media", T.BinaryType())] * with_media

    def work(texts: list) -> list:
        columns: list[list] = [[] for _ in fields]
        for text in texts:
            payload, n = payload_of(text)
            media = encode_samples(payload)
            gif = decode(media)
            back = b"".join(f.samples.tobytes() for f in gif.frames)
            shown = histogram(gif)
            total = np.sum([h for _, h in shown], axis=0)
            values = [n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(gif, shown)]
            values += [len(shown), 10 * sum(d for d, _ in shown), total]
            for column, value in zip(columns, values + [media] * with_media, strict=True):
                column.append(value)
        return columns

    return append_columns(docs, [text_col], fields, work, keep)


FRAMES = T.ArrayType(T.StructType([T.StructField("at_ms", T.LongType()), T.StructField("delay_ms", T.LongType()), T.StructField("colours", T.ArrayType(T.LongType())), T.StructField("rgba", T.BinaryType())]))


def decode_media(media: DataFrame, *, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Adds ``width``, ``height`` and ``frames`` (time, delay, histogram, pixels) to rows of GIF files.

    A null or broken file has null columns.
    """
    fields = [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("frames", FRAMES)]

    def work(files: list) -> list:
        columns: list[list] = [[], [], []]
        for data in files:
            try:
                gif = decode(bytes(data))
                at, frames = 0, []
                for delay, canvas in compose(gif):
                    frames.append({"at_ms": at, "delay_ms": 10 * delay, "colours": colours(canvas).tolist(), "rgba": canvas.tobytes()})
                    at += 10 * delay
                row = [gif.width, gif.height, frames]
            except (ValueError, TypeError, IndexError, struct.error):
                row = [None, None, None]
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        return columns

    return append_columns(media, [media_col], fields, work, keep)
