"""Baseline JPEG media columns: marker parsing, Huffman decoding, DC-only luminance thumbnails and their hashes.

Reading works for any baseline (SOF0) file: interleaved or separate scans, sampling factors, restart intervals. All
restart intervals of a batch of files are decoded in lockstep, a coefficient of each at a time, as numpy arrays.

Writing stores bytes losslessly as quantised coefficients. Byte b becomes the coefficient b - 128, or b - 127 from 128 on,
so none is zero; a block of 64 bytes fills one 8x8 block in zigzag order, three blocks (Y, Cb, Cr) make an MCU of 192
bytes and a restart interval. The Huffman table gives size s a code of 9 - s bits, so each coefficient takes nine bits.
A comment segment holds the payload's length; MCUs beyond it fill the last row.

Defined results: null and empty texts are one MCU of padding; equal payloads, so also repeated rows, give equal files; a
very long text is one image, up to the format's limit of 65,528 pixels a side (12 GB of text), beyond which it raises
ValueError, as files that break the format do; an empty table gives an empty table; other columns don't matter, whatever
their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices, text_bytes

UNIT = 192
PAD = 32
ROW_MCUS = 64
#: Bytes that are coded or decoded together, in whole MCUs and restart intervals; a longer interval is looked at alone.
RUN_BYTES = 1 << 20
MOST_ROWS = 8191  # of blocks: a JPEG side has 16 bits

_VALUES = np.where(np.arange(256) < 128, np.arange(256) - 128, np.arange(256) - 127)
_SIZES = np.array([int(abs(v)).bit_length() for v in _VALUES])
# the code of size s is 8 - s ones and a zero; below it the value's s bits, a negative one less one
_NINE = ((((1 << (8 - _SIZES)) - 1) << 1) << _SIZES | np.where(_VALUES > 0, _VALUES, _VALUES + (1 << _SIZES) - 1)).astype(np.uint16)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(mcus: int, payload: int) -> tuple[bytes, int]:
    """All up to the scan's data, and how many MCUs the image has."""
    wide = min(mcus, max(ROW_MCUS, -(-mcus // MOST_ROWS)))
    high = -(-mcus // wide)
    if wide > MOST_ROWS:
        raise ValueError("a payload is too large for one image")
    tables = bytes([0, 8] + [1] * 63)
    codes = bytes([1] * 8 + [0] * 8) + bytes(range(8, 0, -1))
    parts = [
        b"\xff\xd8",
        _segment(0xFE, b"payload %d" % payload),
        _segment(0xDB, tables),
        _segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _segment(0xC4, b"\x00" + codes),
        _segment(0xC4, b"\x10" + codes),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])),
    ]
    return b"".join(parts), wide * high


def encode(payloads: list[bytes]) -> list[bytes]:
    """One file for each payload; a payload's length is a positive multiple of 192."""
    heads = [_head(len(p) // UNIT, len(p)) for p in payloads]
    full = np.frombuffer(b"".join(p + b" " * (n * UNIT - len(p)) for p, (_, n) in zip(payloads, heads, strict=True)), np.uint8)
    first = np.concatenate([[0], np.cumsum([n for _, n in heads])])
    made, begin, size = [], [], 0
    for low in range(0, len(full) // UNIT, RUN_BYTES // UNIT):
        part = full[low * UNIT : low * UNIT + RUN_BYTES // UNIT * UNIT]
        mcu = np.arange(low, low + len(part) // UNIT)
        in_image = mcu - first[np.searchsorted(first, mcu, side="right") - 1]
        data, place = _scan_data(part, in_image)
        begin += (size + place[in_image == 0]).tolist()
        size += len(data)
        made.append(data)
    stored = np.concatenate(made) if made else np.zeros(0, np.uint8)
    return [h + stored[a:b].tobytes() + b"\xff\xd9" for (h, _), a, b in zip(heads, begin, [*begin, size][1:], strict=True)]


def _scan_data(payload: np.ndarray, in_image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stuffed bits of whole MCUs, with a restart marker before each but an image's first, and the place of each MCU."""
    v = _NINE[payload].reshape(-1, 8)
    packed = np.empty((len(v), 9), np.uint8)
    packed[:, 0] = v[:, 0] >> 1
    for k in range(1, 8):
        packed[:, k] = (v[:, k - 1] << (8 - k)) & 0xFF | v[:, k] >> (k + 1)
    packed[:, 8] = v[:, 7] & 0xFF
    flat = packed.ravel()  # 216 bytes an MCU
    shift = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(flat == 0xFF, out=shift[1:])
    marks = 2 * np.cumsum(in_image > 0)
    place = np.arange(len(flat)) + shift[:-1] + np.repeat(marks, 216)
    out = np.zeros(len(flat) + int(shift[-1]) + int(marks[-1]), np.uint8)
    out[place] = flat
    place = place[::216]
    later = in_image > 0
    out[place[later] - 2] = 0xFF
    out[place[later] - 1] = 0xD0 + (in_image[later] - 1) % 8
    return out, place


@dataclass
class Image:
    width: int = 0
    height: int = 0
    comment: bytes = b""
    components: dict = field(default_factory=dict)  # id: (h, v, quantisation table, index)
    scans: list = field(default_factory=list)
    dc: dict = field(default_factory=dict)


_LOOKUPS: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits the code's length times 256 plus its symbol; 0 where no code begins so."""
    if table not in _LOOKUPS:
        out, code, k = np.zeros(1 << 16, np.int32), 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                at = code << (16 - length)
                if at >= 1 << 16 or k >= len(table):
                    raise ValueError("a Huffman table is overfull")
                out[at : at + (1 << (16 - length))] = length << 8 | table[k]
                code, k = code + 1, k + 1
            code <<= 1
        _LOOKUPS[table] = out
    return _LOOKUPS[table]


def parse(data: bytes) -> Image:
    """The frame and, for each scan, its components, tables, restart interval and place in the data."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    image, at, tables, quant, interval = Image(), 2, {}, {}, 0
    whole = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero(whole[:-1] == 0xFF)
    after = whole[marks + 1]
    ends = marks[(after != 0) & (after != 0xFF) & ((after & 0xF8) != 0xD0)]
    while True:
        while data[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xD9:
            return image
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(int)
                body = body[1 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif kind == 0xC0:
            bits, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not image.width or not image.height:
                raise ValueError("not an eight-bit baseline frame")
            for k in range(n):
                i, hv, q = body[6 + 3 * k : 9 + 3 * k]
                image.components[i] = (hv >> 4, hv & 15, q, k)
        elif 0xC1 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif kind == 0xDD:
            interval = struct.unpack_from(">H", body)[0]
        elif kind == 0xFE:
            image.comment = body
        elif kind == 0xDA:
            parts = [(body[1 + 2 * k], tables[body[2 + 2 * k] >> 4], tables[0x10 | body[2 + 2 * k] & 15]) for k in range(body[0])]
            k = int(np.searchsorted(ends, at))
            end = int(ends[k]) if k < len(ends) else len(data)
            image.scans.append((parts, interval, at, end, {i: quant[c[2]] for i, c in image.components.items()}))
            at = end


def _plan(image: Image, parts) -> tuple[list[int], int, int]:
    """Which component each block of an MCU belongs to, and the MCUs in a row and of a column."""
    most_h = max(c[0] for c in image.components.values())
    most_v = max(c[1] for c in image.components.values())
    if len(parts) == 1:
        h, v, _, _ = image.components[parts[0][0]]
        wide = -(-(-(-image.width * h // most_h)) // 8)
        high = -(-(-(-image.height * v // most_v)) // 8)
        return [0], wide, high
    order = [k for k, (i, _, _) in enumerate(parts) for _ in range(image.components[i][0] * image.components[i][1])]
    return order, -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))


def decode(files: list[bytes]) -> list[tuple[Image, list[np.ndarray]]]:
    """Each file's frame and, for each scan, its quantised coefficients (blocks x 64, zigzag order, DC predicted) in scan order."""
    images = [parse(f) for f in files]
    jobs = [(k, s) for k, image in enumerate(images) for s in range(len(image.scans))]
    raw, lens, blocks, seg_first, seg_bytes, seg_blocks, seg_job, plans = [], [], [], [], [], [], [], []
    for job, (k, s) in enumerate(jobs):
        parts, interval, begin, end, _ = images[k].scans[s]
        order, wide, high = _plan(images[k], parts)
        data = np.frombuffer(files[k], np.uint8)[begin:end]
        n = wide * high
        step = interval or n
        count = -(-n // step)
        cut = np.flatnonzero((data[:-1] == 0xFF) & ((data[1:] & 0xF8) == 0xD0)) if interval else np.zeros(0, int)
        if len(cut) != count - 1:
            raise ValueError("restart markers don't match the interval")
        raw.append(data)
        lens.append(len(data))
        base = sum(lens[:-1]) if job < 2 else base + lens[-2]
        seg_first.append(base + np.append(0, cut + 2))
        seg_bytes.append(base + np.append(cut, len(data)))
        own = np.full(count, step * len(order))
        own[-1] = (n - step * (count - 1)) * len(order)
        seg_blocks.append(own)
        seg_job.append(np.full(count, job))
        blocks.append(n * len(order))
        plans.append((order, parts))
    if not jobs:
        return [(image, []) for image in images]
    data = raw[0] if len(raw) == 1 else np.concatenate(raw)
    bits = _read(data, np.concatenate(seg_first), np.concatenate(seg_bytes), np.concatenate(seg_blocks), np.concatenate(seg_job), plans)
    out: list[tuple[Image, list[np.ndarray]]] = [(image, []) for image in images]
    at = 0
    for (k, _), n in zip(jobs, blocks, strict=True):
        out[k][1].append(bits[at : at + n])
        at += n
    return out


def _read(data, first, last, seg_blocks, seg_job, plans) -> np.ndarray:
    """Coefficients of all restart intervals, which lie at bytes first to last of the scans' stuffed data."""
    names: dict[bytes, int] = {}
    longest = max(len(order) for order, _ in plans)
    shape = (len(plans), longest)
    part, dc_table, ac_table, cycle = np.zeros(shape, int), np.zeros(shape, int), np.zeros(shape, int), np.zeros(len(plans), int)
    for j, (order, parts) in enumerate(plans):
        cycle[j] = len(order)
        for b, p in enumerate(order):
            part[j, b] = p
            dc_table[j, b] = names.setdefault(parts[p][1], len(names))
            ac_table[j, b] = names.setdefault(parts[p][2], len(names))
    lut = np.concatenate([_lookup(t) for t in names])
    out = np.zeros((int(seg_blocks.sum()), 64), np.int16)
    block = np.concatenate([[0], np.cumsum(seg_blocks)])
    for i, j in slices(np.append(first, last[-1]), RUN_BYTES):
        begin = first[i]
        part_data = data[begin : last[j - 1]]
        keep = np.ones(len(part_data), bool)
        keep[1:] = ~((part_data[:-1] == 0xFF) & (part_data[1:] == 0))
        starts = first[i:j] - begin
        keep[starts[starts < len(part_data)]] = True  # an interval that begins with 0 after another's last byte
        moved = np.zeros(len(part_data) + 1, np.int64)
        np.cumsum(keep, out=moved[1:])
        spans = moved[starts], moved[last[i:j] - begin]
        _read_run(out.ravel(), part_data[keep], *spans, block[i:j], block[i + 1 : j + 1], seg_job[i:j], lut, part, dc_table, ac_table, cycle)
    return out


def _read_run(flat, data, first, last, block, stop, seg_job, lut, part, dc_table, ac_table, cycle) -> None:
    """Decode intervals in lockstep into flat, blocks `block` to `stop` of it each; data is free of stuffing."""
    wide = np.concatenate([data, np.full(8, 0xFF, np.uint8)]).astype(np.int64)
    five = wide[:-7] << 32 | wide[1:-6] << 24 | wide[2:-5] << 16 | wide[3:-4] << 8 | wide[4:-3]
    bit, end = first * 8, last * 8
    job, turn, k = seg_job, np.zeros(len(first), int), np.zeros(len(first), int)
    before = np.zeros((len(first), 4), np.int64)
    row = np.arange(len(first))
    while len(row):
        window = five[bit >> 3] >> (8 - (bit & 7)) & 0xFFFFFFFF
        is_dc = k == 0
        name = np.where(is_dc, dc_table[job, turn], ac_table[job, turn])
        found = lut[(name << 16) + (window >> 16)]
        length, size = found >> 8, found & 15
        run = np.where(is_dc, 0, found >> 4 & 15)
        extra = window >> (32 - length - size) & ((1 << size) - 1)
        value = np.where(extra >> np.maximum(size - 1, 0), extra, extra - (1 << size) + 1)
        bit = bit + length + size
        if not length.all() or (bit > end).any():
            raise ValueError("a scan's data is damaged")
        ended = ~is_dc & (size == 0) & (run < 15)
        k = np.where(ended, 64, k + run)
        if (k[~ended] > 63).any():
            raise ValueError("a run leaves its block")
        if is_dc.any():
            d = np.flatnonzero(is_dc)
            p = part[job[d], turn[d]]
            before[row[d], p] += value[d]
            value[d] = before[row[d], p]
        put = (size > 0) | is_dc
        flat[(block * 64 + k)[put]] = value[put]
        k = k + ~ended
        done = k > 63
        if done.any():
            block = block + done
            turn = np.where(done, (turn + 1) % cycle[job], turn)
            k = np.where(done, 0, k)
            on = block < stop
            if not on.all():
                row, bit, end, job, turn, k, block, stop = (x[on] for x in (row, bit, end, job, turn, k, block, stop))


def thumbnail(image: Image, scans: list[np.ndarray]) -> np.ndarray:
    """A luminance sample for each 8x8 block of the first component, from its DC coefficient alone."""
    luma = next(i for i, c in image.components.items() if c[3] == 0)
    most_h = max(c[0] for c in image.components.values())
    most_v = max(c[1] for c in image.components.values())
    h, v, _, _ = image.components[luma]
    for (parts, _, _, _, quant), coefficients in zip(image.scans, scans, strict=True):
        ids = [p[0] for p in parts]
        if luma not in ids:
            continue
        order, wide, high = _plan(image, parts)
        own = coefficients[:, 0].reshape(high, wide, len(order))[:, :, [k for k, p in enumerate(order) if ids[p] == luma]].astype(np.int64)
        if len(parts) > 1:
            own = own.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
        else:
            own = own.reshape(high, wide)
        rows, cols = -(-(-(-image.height * v // most_v)) // 8), -(-(-(-image.width * h // most_h)) // 8)
        return np.clip((own[:rows, :cols] * int(quant[luma][0]) + 4) // 8 + 128, 0, 255).astype(np.uint8)
    raise ValueError("no scan holds the luminance")


def feature(image: Image, thumb: np.ndarray) -> str:
    """Dimensions, the thumbnail's difference hash over a grid of 8 x 9 samples, and a digest of the thumbnail."""
    rows, cols = np.arange(8) * thumb.shape[0] // 8, np.arange(9) * thumb.shape[1] // 9
    grid = thumb[rows][:, cols]
    difference = np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex()
    return f"{image.width}x{image.height}:{difference}:{hashlib.sha1(thumb.tobytes()).hexdigest()[:16]}"


def payload_of(image: Image, scans: list[np.ndarray]) -> bytes:
    """The bytes that `encode` stored."""
    v, out = scans[0].ravel(), np.empty(scans[0].size, np.uint8)
    if not image.comment.startswith(b"payload "):
        raise ValueError("this file holds no payload")
    for i in range(0, len(v), RUN_BYTES):
        part = v[i : i + RUN_BYTES]
        if (part == 0).any():
            raise ValueError("this file holds no payload")
        out[i : i + RUN_BYTES] = part + 127 + (part < 0)
    return out[: int(image.comment[8:])].tobytes()


def with_media(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_bytes of each text and media, the JPEG file that stores it."""
    kept = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), "n_bytes long, media binary"])

    def batches(it):
        for batch in it:
            data, offsets = text_bytes(batch.column(len(keep)))
            for i, j in slices(offsets):
                part = data[offsets[i] : offsets[j]].tobytes()
                places = (offsets[i : j + 1] - offsets[i]).tolist()
                raw = [part[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
                media = encode([r + bytes([PAD]) * (-len(r) % UNIT if r else UNIT) for r in raw])
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[: len(keep)]), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])

    return mapped(kept, batches, schema)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumbnail_sha1 string, feature string"


def with_features(media: DataFrame, column: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """`keep` and what each stored file tells (see FEATURES)."""
    kept = media.select(*keep, column)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), FEATURES])
    names = [x.split()[0] for x in FEATURES.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]] for x in FEATURES.split(", ")]

    def batches(it):
        for batch in it:
            stored = batch.column(len(keep))
            _, offsets = text_bytes(stored)
            for i, j in slices(offsets):
                files = stored.slice(i, j - i).to_pylist()
                rows = []
                for f, (image, scans) in zip(files, decode(files), strict=True):
                    payload, thumb = payload_of(image, scans), thumbnail(image, scans)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(f), hashlib.sha256(f).hexdigest(), image.width, image.height, hashlib.sha1(thumb.tobytes()).hexdigest(), feature(image, thumb)))
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[: len(keep)]), *arrays], names=[*keep, *names])

    return mapped(kept, batches, schema)
