import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factpanel.llm import gif, queries


def compress(samples: bytes, min_bits: int, *, clear_at: int = 4096) -> bytes:
    """A plain LZW encoder that uses its whole dictionary, to test the decoder with."""
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    bits, out = [], []

    def emit(code, width):
        bits.extend(code >> i & 1 for i in range(width))

    table = {bytes([i]): i for i in range(clear)}
    width, size, prefix = min_bits + 1, end + 1, b""
    emit(clear, width)
    for b in samples:
        s = prefix + bytes([b])
        if s in table:
            prefix = s
            continue
        emit(table[prefix], width)
        if size < 4096:
            table[s] = size
            size += 1
            if size == (1 << width) + 1 and width < 12:
                width += 1
        if size >= clear_at:
            emit(clear, width)
            table = {bytes([i]): i for i in range(clear)}
            width, size = min_bits + 1, end + 1
        prefix = bytes([b])
    if prefix:
        emit(table[prefix], width)
    emit(end, width)
    out = np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 8), st.integers(0, 2**32 - 1), st.sampled_from([1, 2, 10, 300, 3000, 20000]), st.sampled_from([1, 3, 256]), st.sampled_from([600, 4096, 5000]))
def test_decoder_reads_what_a_full_encoder_writes(min_bits, seed, n, colours, clear_at):
    rng = random.Random(seed)
    samples = bytes(rng.randrange(min(colours, 1 << min_bits)) for _ in range(n))
    data = compress(samples, min_bits, clear_at=clear_at)
    assert gif.lzw_decode(data, min_bits, n).tobytes() == samples


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=5000))
def test_round_trip(raw):
    payload = raw + b"\0" * (-len(raw) % 64)
    back = gif.decode(gif.encode_samples(payload))
    assert b"".join(f.samples.tobytes() for f in back.frames) == payload
    assert gif.lzw_encode(payload) == compress(payload, 8)


@pytest.mark.parametrize("n", [3838, 3839, 3840, 20_000])
def test_full_dictionaries_begin_anew(n):
    rng = random.Random(n)
    for samples in (bytes(rng.randrange(256) for _ in range(n)), bytes(rng.randrange(3) for _ in range(20 * n)), b"\7" * n):
        data = gif.lzw_encode(samples)
        assert data == compress(samples, 8) and gif.lzw_decode(data, 8, len(samples)).tobytes() == samples


def test_long_payloads_take_several_frames():
    payload = bytes(range(256)) * 160
    back = gif.decode(gif.encode_samples(payload))
    assert [f.height for f in back.frames] == [256, 256, 128] and {(f.delay, f.disposal) for f in back.frames} == {(10, 2)}
    assert b"".join(f.samples.tobytes() for f in back.frames) == payload


def image(left, top, w, h, samples, *, delay=0, disposal=0, transparent=None, palette=None, interlaced=False):
    flags = disposal << 2 | (transparent is not None)
    out = b"\x21\xf9\x04" + struct.pack("<BHB", flags, delay, transparent or 0) + b"\0"
    out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, (0x80 | 1 if palette else 0) | 0x40 * interlaced) + (palette or b"")
    return out + b"\x02" + gif._blocks(compress(bytes(samples), 2))


def test_disposal_transparency_palettes_and_interlacing():
    red, green, blue, white = (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255)
    table = bytes(sum((red, green, blue, white), ()))
    local = bytes(sum((white, blue, green, red), ()))
    data = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80 | 1, 0, 0) + table
    data += image(0, 0, 2, 2, [0, 0, 0, 0], delay=5, disposal=1)
    data += image(0, 0, 1, 1, [1], delay=7, disposal=3)
    data += image(0, 0, 2, 1, [3, 2], transparent=3, disposal=2)
    data += image(1, 1, 1, 1, [0], palette=local)
    data += b"\x21\xfe\x03abc\0\x3b"
    shown = [c[..., :3].reshape(-1, 3).tolist() for _, c in gif.compose(gif.decode(data))]
    alpha = [c[..., 3].reshape(-1).tolist() for _, c in gif.compose(gif.decode(data))]
    r, g, b, w = map(list, (red, green, blue, white))
    assert shown[0] == [r, r, r, r] and shown[1] == [g, r, r, r]  # the second frame is taken back
    assert shown[2] == [r, b, r, r]  # a transparent sample leaves what was there
    assert shown[3][3] == w and alpha[3] == [0, 0, 255, 255]  # the third frame's area became background
    assert [f.delay for f in gif.decode(data).frames] == [5, 7, 0, 0]
    rows = b"GIF87a" + struct.pack("<HHBBB", 1, 9, 0x80 | 1, 0, 0) + table + image(0, 0, 1, 9, [0, 1, 2, 3, 0, 1, 2, 3, 0], interlaced=True) + b";"
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    want = np.zeros(9, int)
    want[order] = [0, 1, 2, 3, 0, 1, 2, 3, 0]
    assert gif.decode(rows).frames[0].samples.reshape(-1).tolist() == want.tolist()


def plain_feature(payload):
    """The feature of a stored payload by hand: frames of 16,384 samples, none of which lasts into the next."""
    parts, counts = [payload[i : i + 16_384] for i in range(0, len(payload), 16_384)], [0] * 64
    for b in payload:
        r, g, blue = (b >> 5) * 255 // 7, (b >> 2 & 7) * 255 // 7, (b & 3) * 255 // 3
        counts[(r // 64) * 16 + (g // 64) * 4 + blue // 64] += 1
    return f"64x{len(parts[0]) // 64};frames={len(parts)};ms={100 * len(parts)};rgb=" + ",".join(map(str, counts))


def test_histograms_count_what_is_shown():
    payload = bytes([0] * 64 + [255] * 64)
    (delay, counts), = gif.histogram(gif.decode(gif.encode_samples(payload, delay=3)))
    assert delay == 3 and counts[0] == 64 and counts[-1] == 64 and sum(counts) == 128
    drawn = [int(c[..., 0].sum()) for _, c in gif.compose(gif.decode(gif.encode_samples(payload)))]
    assert drawn == [255 * 64]


def test_hostile_sizes_are_refused(spark):
    table = bytes(12)
    huge = b"GIF89a" + struct.pack("<HHBBB", 65_535, 65_535, 0x80 | 1, 0, 0) + table + image(0, 0, 1, 1, [0]) + b";"
    wide = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80 | 1, 0, 0) + table + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65_535, 65_535, 0) + b"\x02\0;"
    odd = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80 | 1, 0, 0) + table + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\xff\0;"
    rows = gif.decode_media(spark.createDataFrame([(bytearray(x),) for x in (huge, wide, odd)], "media binary")).collect()
    assert all(r["frames"] is None for r in rows)


def test_query(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op9_gif(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["feature"] == plain_feature(payload) and r["n_frames"] == -(-len(payload) // 16_384) and sum(r["colours"]) == len(payload)


def test_odd_rows_and_media_columns(spark, odd_documents, no_documents):
    rows = gif.store_texts(odd_documents, with_media=True).collect()
    for r in rows:
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest()
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"] or "", (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert gif.store_texts(no_documents).count() == 0
    media = spark.createDataFrame([(1, bytes(rows[0]["media"])), (2, b"no image"), (3, None), (4, b"")], "id int, media binary")
    out = {r["id"]: r for r in gif.decode_media(media).collect()}
    assert out[1]["width"] == 64 and len(out[1]["frames"][0]["rgba"]) == 64 * out[1]["height"] * 4
    assert all(out[i]["frames"] is None for i in (2, 3, 4))


def test_wrong_payload_is_refused():
    with pytest.raises(ValueError):
        gif.encode_samples(b"abc")
