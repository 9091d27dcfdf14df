import hashlib
import struct
import tracemalloc
import zlib

import numpy as np
import pytest

from caselake.llm import jpeg


def test_table_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = jpeg.with_features(jpeg.with_media(docs)).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-16:])


def test_a_very_long_text_takes_memory_in_proportion():
    text = b"".join(b"line %d of a very long text\n" % i for i in range(1_000_000))
    text += b" " * (-len(text) % 192)
    tracemalloc.start()
    try:
        (media,) = jpeg.encode([text])
        ((image, scans),) = jpeg.decode([media])
        assert jpeg.payload_of(image, scans) == text
        assert tracemalloc.get_traced_memory()[1] < 6 * len(text)
    finally:
        tracemalloc.stop()


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 1), (2, "", 1), (3, "é" * 96, 1), (4, "x" * 200_000, 1), (None, "ÿ\x00" * 500, 1)]
    got = jpeg.with_features(jpeg.with_media(spark.createDataFrame(rows, "doc_id long, text string, media int"))).collect()
    assert [r.payload_bytes for r in got] == [192, 192, 192, 192, 200_064, 1536]
    assert got[0].feature == got[1].feature and got[0].media_sha256 == got[2].media_sha256
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jpeg.with_features(jpeg.with_media(empty)).count() == 0


def test_all_byte_values_and_sizes():
    rng = np.random.default_rng(1)
    payloads = [bytes(range(256)) * 3, b"\xff" * 192, b"\x00" * 384, *(rng.integers(0, 256, 192 * n, np.uint8).tobytes() for n in (1, 63, 64, 65, 200))]
    files = jpeg.encode(payloads)
    assert [jpeg.payload_of(*x) for x in jpeg.decode(files)] == payloads
    assert files == [jpeg.encode([p])[0] for p in payloads]
    with pytest.raises(ValueError):
        jpeg.decode([files[0][:300] + b"\xff\xd9"])


@pytest.mark.parametrize("most", [192, 500, 4000])
def test_runs_do_not_show(monkeypatch, most):
    rng = np.random.default_rng(2)
    payloads = [rng.integers(0, 256, 192 * n, np.uint8).tobytes() for n in (1, 40, 3, 1, 90)]
    whole = jpeg.encode(payloads)
    sub = sparse(rng, 54)
    others = [other_encoder(sub, [0, 0, 0, 0, 1, 2], 3, 48, 33, i, [0x22, 0x11, 0x11]) for i in (0, 2, 4)]
    monkeypatch.setattr(jpeg, "RUN_BYTES", most)
    assert jpeg.encode(payloads) == whole and jpeg.encode([]) == []
    assert [jpeg.payload_of(*x) for x in jpeg.decode(whole)] == payloads
    assert all((scans[0] == sub).all() for _, scans in jpeg.decode(others))


def other_encoder(coefficients, order, parts, width, height, interval, sampling, separate=False):
    """A plain bit-by-bit writer with zero runs, end-of-block codes and a 16-long code table."""
    symbols = [0x00, 0xF0, *range(1, 12), *(r << 4 | s for r in range(1, 16) for s in (1, 2, 3))]
    lengths = [2] + [7] * (len(symbols) - 1)
    table = bytes([lengths.count(n) for n in range(1, 17)]) + bytes(symbols)
    codes, code, last = {}, 0, 2
    for s, n in zip(symbols, lengths):
        code <<= n - last
        codes[s], code, last = (code, n), code + 1, n
    bits = lambda v, n: format(v, f"0{n}b") if n else ""
    size = lambda v: abs(int(v)).bit_length()
    low = lambda v: bits(int(v) if v > 0 else int(v) + (1 << size(v)) - 1, size(v))

    def scan(blocks, order):
        out, pred, text, n = b"", {}, "", 0
        mcus = len(blocks) // len(order)

        def flush(t):
            t += "1" * (-len(t) % 8)
            return bytes(int(t[i : i + 8], 2) for i in range(0, len(t), 8)).replace(b"\xff", b"\xff\x00")

        for m in range(mcus):
            if interval and m and m % interval == 0:
                out += flush(text) + bytes([0xFF, 0xD0 + n % 8])
                text, pred, n = "", {}, n + 1
            for b, p in enumerate(order):
                c = blocks[m * len(order) + b]
                d = c[0] - pred.get(p, 0)
                pred[p] = c[0]
                text += bits(*codes[size(d)]) + low(d)
                run = 0
                for v in c[1:]:
                    if v == 0:
                        run += 1
                        continue
                    while run > 15 or (run and (run << 4 | size(v)) not in codes):
                        assert run > 15
                        text += bits(*codes[0xF0])
                        run -= 16
                    text += bits(*codes[run << 4 | size(v)]) + low(v)
                    run = 0
                if run:
                    text += bits(*codes[0])
        return out + flush(text)

    seg = jpeg._segment
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + bytes(range(16, 80))) + seg(0xC0, struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([i + 1, hv, 0]) for i, hv in enumerate(sampling))) + seg(0xC4, b"\x00" + table + b"\x11" + table)
    if interval:
        out += seg(0xDD, struct.pack(">H", interval))
    if separate:
        for p, blocks in enumerate(coefficients):
            out += seg(0xDA, bytes([1, p + 1, 0x01, 0, 63, 0])) + scan(blocks, [0])
    else:
        out += seg(0xDA, bytes([parts]) + b"".join(bytes([p + 1, 0x01]) for p in range(parts)) + bytes([0, 63, 0])) + scan(coefficients, order)
    return out + b"\xff\xd9"


def sparse(rng, n):
    c = np.zeros((n, 64), np.int64)
    c[:, 0] = rng.integers(-60, 60, n)
    for row in c:
        at = rng.choice(np.arange(1, 64), 8, replace=False)
        row[at] = rng.integers(-7, 8, 8)
    c[0, 1:] = 0
    c[-1, 63] = 5
    return c


def test_other_files_subsampled_and_separate_scans():
    rng = np.random.default_rng(3)
    sub = sparse(rng, 6 * 6)  # 4:2:0, 48 x 33 pixels: 3 x 3 MCUs of 6 blocks
    sub = np.concatenate([sub, sparse(rng, 18)])
    files = [other_encoder(sub, [0, 0, 0, 0, 1, 2], 3, 48, 33, i, [0x22, 0x11, 0x11]) for i in (0, 2, 4)]
    grey = sparse(rng, 12)
    files += [other_encoder([grey, -grey], None, 2, 30, 20, 0, [0x11, 0x11], True)]
    got = jpeg.decode(files)
    for image, scans in got[:3]:
        assert (scans[0] == sub).all()
        thumb = jpeg.thumbnail(image, scans)
        luma = sub[:, 0].reshape(3, 3, 6)[:, :, :4].reshape(3, 3, 2, 2).transpose(0, 2, 1, 3).reshape(6, 6)
        assert (thumb == np.clip((luma[:5] * 16 + 4) // 8 + 128, 0, 255)).all()
    assert [(s == w).all() for s, w in zip(got[3][1], [grey, -grey])] == [True, True]
