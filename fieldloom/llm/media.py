"""Media columns as baseline JPEG: writing payloads losslessly, and parsing, Huffman decoding and thumbnails in numpy.

A payload byte is stored as one quantised coefficient, the format's own unit: 64 bytes make
the 64 zigzag coefficients of one 8x8 luminance block, each shifted by -128 as JPEG shifts
levels. Every block is a restart interval, so blocks neither depend on each other nor on the
DC prediction, and decoding runs over many blocks at once. The decoder reads any baseline
greyscale stream, with or without restart intervals.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .shared import prepare

BLOCK = 64
#: Blocks in a row of an image; a row's height of 8 leaves room for 8191 rows.
MAX_COLUMNS = 8191
#: Bytes of payload that one step works on.
STEP = 1 << 19

#: Marker codes of the format.
SOI, EOI, SOS, DQT, DHT, SOF0, DRI, COM, RST0 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xC0, 0xDD, 0xFE, 0xD0


class Huffman:
    """A canonical Huffman table: codes and lengths by symbol, and a 16-bit prefix lookup."""

    def __init__(self, counts, symbols):
        self.counts, self.symbols = np.asarray(counts, np.uint8), np.asarray(symbols, np.uint8)
        self.code, self.size = np.zeros(256, np.uint32), np.zeros(256, np.uint8)
        self.look_symbol, self.look_size = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code = i = 0
        for bits in range(1, 17):
            for _ in range(int(self.counts[bits - 1])):
                s = int(self.symbols[i])
                self.code[s], self.size[s] = code, bits
                at = code << (16 - bits)
                self.look_symbol[at : at + (1 << (16 - bits))] = s
                self.look_size[at : at + (1 << (16 - bits))] = bits
                code, i = code + 1, i + 1
            code <<= 1


def _flat(symbols) -> Huffman:
    """A table that gives the first symbols 4 bits and the others 10, leaving the all-ones code free."""
    counts = [0] * 16
    counts[3] = min(14, len(symbols))
    counts[9] = len(symbols) - counts[3]
    return Huffman(counts, symbols)


#: Symbols in the order of their likelihood in text: sizes of letters, of white space, then zero runs.
DC_TABLE = _flat([5, 4, 3, 7, 6, 8, 2, 1, 0, 9, 10, 11])
AC_TABLE = _flat([5, 4, 3, 7, 6, 8, 2, 1, 0x15, 0x14, 0x13, 0x17, 0x00, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 9) if r << 4 | s not in (*range(1, 9), 0x15, 0x14, 0x13, 0x17)])


_CATEGORY = np.array([int(i).bit_length() for i in range(2048)], np.int64)
#: By size: the code of a coefficient that follows no zero, and its bits with the extra bits.
_AC_SHORT = np.where(np.arange(12) > 0, AC_TABLE.code[:12], 0).astype(np.int64)
_AC_WIDTH = np.where(np.arange(12) > 0, AC_TABLE.size[:12] + np.arange(12), 0).astype(np.int64)


def _scan(coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes (stuffed) of blocks (n, 64), one restart interval each: the bytes, and where each block's begin, n + 1 long."""
    n = len(coefficients)
    size = _CATEGORY[np.abs(coefficients)]
    extra = np.where(coefficients < 0, coefficients + (1 << size) - 1, coefficients)
    # one field for each coefficient (no bits for a zero), and one that ends the block
    value, width = np.zeros((n, 66), np.int64), np.zeros((n, 66), np.int64)
    ac = _AC_SHORT[size]
    value[:, :64] = ac << size | extra
    width[:, :64] = _AC_WIDTH[size]
    dc = size[:, 0]
    value[:, 0], width[:, 0] = DC_TABLE.code[dc].astype(np.int64) << dc | extra[:, 0], DC_TABLE.size[dc] + dc
    zero = coefficients == 0
    zero[:, 0] = False
    some = np.flatnonzero(zero.any(1))
    if len(some):  # blocks with zeros: runs before each other coefficient, and the end-of-block code
        at = np.where(zero[some], 0, np.arange(64))
        seen = np.maximum.accumulate(at, 1)
        run = np.zeros_like(at)
        run[:, 1:] = np.arange(1, 64) - seen[:, :-1] - 1
        s, skip = size[some], run >> 4
        symbol = (run & 15) << 4 | s
        code, bits = AC_TABLE.code[symbol].astype(np.int64), AC_TABLE.size[symbol].astype(np.int64)
        zrl, long_ = int(AC_TABLE.code[0xF0]), int(AC_TABLE.size[0xF0])
        for k in range(1, 4):
            code = np.where(skip >= k, zrl << (bits + long_ * (k - 1)) | code, code)
        bits = bits + long_ * skip
        v, w = code << s | extra[some], bits + s
        v[zero[some]] = w[zero[some]] = 0
        v[:, 0], w[:, 0] = value[some, 0], width[some, 0]
        value[some, :64], width[some, :64] = v, w
        ends = some[zero[some, 63]]
        value[ends, 64], width[ends, 64] = int(AC_TABLE.code[0]), int(AC_TABLE.size[0])
    bits = width.sum(1)
    pad = -bits % 8
    value[:, 65], width[:, 65] = (1 << pad) - 1, pad  # the last byte is filled with ones
    begin = np.concatenate([[0], np.cumsum((bits + pad) >> 3)])
    value, width = value.ravel(), width.ravel()
    while len(value) % 2 == 0 and len(value) and (pair := width[::2] + width[1::2]).max() <= 48:  # neighbours become one field while they fit
        value, width = value[::2] << width[1::2] | value[1::2], pair
    ends = np.cumsum(width)
    at = ends - width
    word = at >> 4
    count = -(-(int(width.max(initial=0)) + 15) // 16)
    shifted = value << (16 * count - width - (at & 15))
    total = int(begin[-1])
    out = np.zeros((total >> 1) + 6)
    for i in range(count):
        out += np.bincount(word + i, shifted >> (16 * (count - 1 - i)) & 0xFFFF, len(out))
    out = out.astype(">u2").view(np.uint8)[:total]
    stuffed = np.flatnonzero(out == 255)
    return np.insert(out, stuffed + 1, 0), begin + np.searchsorted(stuffed, begin)


def _segment(marker: int, body: bytes = b"") -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(blocks: int) -> bytes:
    columns = min(blocks, MAX_COLUMNS)
    rows = -(-blocks // columns)
    tables = b"".join(bytes([kind << 4]) + t.counts.tobytes() + t.symbols.tobytes() for kind, t in ((0, DC_TABLE), (1, AC_TABLE)))
    return b"".join([
        bytes([0xFF, SOI]), _segment(COM, b"blocks=%d" % blocks), _segment(DQT, bytes([0]) + bytes([8] * 64)),
        _segment(SOF0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 1) + bytes([1, 0x11, 0])),
        _segment(DHT, tables), _segment(DRI, struct.pack(">H", 1)), _segment(SOS, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload; lengths are positive multiples of 64. All payloads' blocks are coded together."""
    blocks = [len(p) // BLOCK for p in payloads]
    padded = [-(-b // min(b, MAX_COLUMNS)) * min(b, MAX_COLUMNS) for b in blocks]
    streams: list[list[bytes]] = [[_head(b)] for b in blocks]
    queue, held = [], 0

    def flush():
        data = np.frombuffer(b"".join(q[1] for q in queue), np.uint8).reshape(-1, BLOCK)
        scan, begin = _scan(data.astype(np.int64) - 128)
        mark = np.concatenate([(np.arange(q[2], q[2] + len(q[1]) // BLOCK)) for q in queue])
        # each block's bytes are followed by its restart marker
        out = np.empty(len(scan) + 2 * len(data), np.uint8)
        place = np.arange(len(scan)) + 2 * np.repeat(np.arange(len(data)), np.diff(begin))
        out[place] = scan
        ends = begin[1:] + 2 * np.arange(len(data))
        out[ends], out[ends + 1] = 0xFF, RST0 + mark % 8
        edges, a = begin + 2 * np.arange(len(data) + 1), 0
        for i, part, _ in queue:
            b = a + len(part) // BLOCK
            streams[i].append(out[edges[a] : edges[b]].tobytes())
            a = b
        queue.clear()

    for i, payload in enumerate(payloads):
        full = payload + bytes(128 for _ in range((padded[i] - blocks[i]) * BLOCK))
        for at in range(0, len(full), STEP):
            part = full[at : at + STEP]
            queue.append((i, part, at // BLOCK))
            held += len(part)
            if held >= STEP:
                flush()
                held = 0
    if queue:
        flush()
    # the last restart marker gives way to the end of the image
    return [b"".join([*s[:-1], s[-1][:-2], bytes([0xFF, EOI])]) for s in streams]


def parse(media: bytes) -> dict:
    """The markers of a baseline greyscale JPEG: dimensions, tables, restart interval, comment, and where the scan stands."""
    if media[:2] != bytes([0xFF, SOI]):
        raise ValueError("no SOI marker")
    out, at, tables, quant = {"restart": 0, "comment": b""}, 2, {}, {}
    while True:
        if media[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = media[at + 1]
        if marker == EOI:
            raise ValueError("no scan")
        (length,) = struct.unpack(">H", media[at + 2 : at + 4])
        body = media[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == SOF0:
            depth, height, width, parts = struct.unpack(">BHHB", body[:6])
            if depth != 8 or parts != 1:
                raise ValueError("only 8-bit greyscale is read")
            out |= {"height": height, "width": width, "quant": body[8]}
        elif 0xC0 <= marker <= 0xCF and marker not in (DHT, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        elif marker == DQT:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8)
                body = body[1 + 64 * wide :]
        elif marker == DHT:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == DRI:
            (out["restart"],) = struct.unpack(">H", body)
        elif marker == COM:
            out["comment"] = body
        elif marker == SOS:
            ids = body[2]
            out |= {"dc": tables[ids >> 4], "ac": tables[0x10 | ids & 15], "scan": at, "quant": quant[out["quant"]]}
            return out


@functools.lru_cache(maxsize=16)
def _table(spec: bytes) -> Huffman:
    return Huffman(list(spec[:16]), list(spec[16:]))


def _decode_lanes(data: np.ndarray, begin: np.ndarray, blocks: np.ndarray, dc: Huffman, ac: Huffman) -> np.ndarray:
    """Coefficients (sum of blocks, 64) of entropy-coded runs without stuffing; each run is a lane of its own, all lanes step together."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = wide[:-4] << np.uint64(32) | wide[1:-3] << np.uint64(24) | wide[2:-2] << np.uint64(16) | wide[3:-1] << np.uint64(8) | wide[4:]  # the 40 bits from each byte on
    out = np.zeros((int(blocks.sum()), 64), np.int16)
    flat = out.ravel()
    place = (np.cumsum(blocks) - blocks) * 64
    stop = place + blocks * 64
    at, last = begin.astype(np.int64) * 8, np.zeros(len(begin), np.int64)
    cell = place.copy()
    while len(cell):
        window = words[at >> 3] << (at & 7).astype(np.uint64)
        head = (window >> np.uint64(24) & np.uint64(0xFFFF)).astype(np.int64)
        first = cell % 64 == 0
        symbol = np.where(first, dc.look_symbol[head], ac.look_symbol[head]).astype(np.int64)
        used = np.where(first, dc.look_size[head], ac.look_size[head]).astype(np.int64)
        if not used.all():
            raise ValueError("a code is not in the Huffman table")
        at += used
        size = symbol & 15
        window = words[at >> 3] << (at & 7).astype(np.uint64)
        raw = (window >> np.uint64(24) & np.uint64(0xFFFF)).astype(np.int64) >> (16 - size)
        value = np.where(raw < 1 << np.maximum(size - 1, 0), raw - (1 << size) + 1, raw)
        at += size
        run = np.where(first, 0, symbol >> 4)
        end = ~first & (symbol == 0)
        value[first] += last[first]
        last[first] = value[first]
        cell += run
        write = first | (size > 0)
        flat[cell[write]] = value[write]
        cell = np.where(end, (cell // 64 + 1) * 64, cell + 1)
        alive = cell < stop
        if not alive.all():
            at, last, cell, stop = at[alive], last[alive], cell[alive], stop[alive]
    return out


def coefficients(media: list[bytes]) -> tuple[list[dict], list[np.ndarray]]:
    """Headers and quantised coefficients (blocks, 64) in zigzag order of each image."""
    heads = [parse(m) for m in media]
    groups: dict[tuple, list[int]] = {}
    for i, h in enumerate(heads):
        groups.setdefault((h["dc"], h["ac"]), []).append(i)
    out: list[np.ndarray] = [np.zeros((0, 64), np.int16)] * len(media)
    for (dc, ac), members in groups.items():
        for i in members:
            out[i] = np.zeros((-(-heads[i]["width"] // 8) * -(-heads[i]["height"] // 8), 64), np.int16)
        a = 0
        while a < len(members):
            b, held = a, 0
            while b < len(members) and (b == a or held + len(media[members[b]]) <= STEP):
                held += len(media[members[b]])
                b += 1
            for part in _pieces([(i, media[i], heads[i], len(out[i])) for i in members[a:b]]):
                data, begin, blocks, owners = part
                got, at = _decode_lanes(data, begin, blocks, _table(dc), _table(ac)), 0
                for i, place, n in owners:
                    out[i][place : place + n] = got[at : at + n]
                    at += n
            a = b
    return heads, out


def _pieces(images):
    """(bytes without stuffing and markers, starts of lanes, blocks of lanes, (image, first block, blocks)) of bounded size."""
    data, starts, blocks, owners, held = [], [], [], [], 0
    for i, media, head, n in images:
        raw = np.frombuffer(media, np.uint8)[head["scan"] :]
        after = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] != 0)) if len(raw) > 1 else np.zeros(0, np.int64)
        codes = raw[after + 1]
        final = after[(codes < RST0) | (codes > RST0 + 7)]
        if not len(final):
            raise ValueError("no end of the scan")
        edges = after[after <= final[0]]
        lane = np.concatenate([[0], edges[:-1] + 2])
        per = head["restart"] or n
        count = np.minimum(per, n - per * np.arange(len(lane)))
        if (count <= 0).any() or count.sum() != n:
            raise ValueError("restart intervals do not cover the image")
        done = 0
        while done < len(lane):
            stop = max(done + 1, int(np.searchsorted(edges, lane[done] + STEP, "right")))
            stop = min(stop, len(lane))
            piece = raw[lane[done] : edges[stop - 1]]
            keep = np.ones(len(piece), bool)
            keep[1:] = ~((piece[:-1] == 0xFF) & (piece[1:] == 0))
            for e in (edges[done : stop - 1] - lane[done],):
                keep[e] = keep[e + 1] = False
            new = np.concatenate([[0], np.cumsum(keep)])
            data.append(piece[keep])
            starts.append(new[lane[done:stop] - lane[done]] + held)
            blocks.append(count[done:stop])
            owners.append((i, per * done, int(count[done:stop].sum())))
            held += int(keep.sum())
            done = stop
            if held >= STEP:
                yield np.concatenate(data), np.concatenate(starts), np.concatenate(blocks), owners
                data, starts, blocks, owners, held = [], [], [], [], 0
    if data:
        yield np.concatenate(data), np.concatenate(starts), np.concatenate(blocks), owners


def thumbnail(head: dict, blocks: np.ndarray) -> np.ndarray:
    """DC-only luminance: one pixel for each block, its mean."""
    rows, columns = -(-head["height"] // 8), -(-head["width"] // 8)
    dc = blocks[:, 0].astype(np.float64) * float(head["quant"][0]) / 8 + 128
    return np.clip(np.rint(dc), 0, 255).astype(np.uint8).reshape(rows, columns)


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64-bit average hash (hex) of the thumbnail laid out as 64 cells in reading order; cells' means against their median."""
    flat = pixels.ravel().astype(np.float64)
    edges = np.linspace(0, len(flat), 65)
    sums = np.concatenate([[0.0], np.cumsum(flat)])
    at = lambda x: np.interp(x, np.arange(len(flat) + 1), sums)
    cells = (at(edges[1:]) - at(edges[:-1])) / (len(flat) / 64)
    return np.packbits(np.round(cells, 6) > np.round(np.median(cells), 6)).tobytes().hex()


def payload_of(head: dict, blocks: np.ndarray) -> bytes | None:
    """The bytes that encode() stored; None for an image that it did not make."""
    if not (head["comment"] or b"").startswith(b"blocks="):
        return None
    n = int(head["comment"].removeprefix(b"blocks="))
    return (blocks[:n] + 128).astype(np.uint8).tobytes()


def _bounded(values: list[bytes], limit: int = 4 * STEP):
    a = 0
    while a < len(values):
        b, held = a, 0
        while b < len(values) and (b == a or held + len(values[b]) <= limit):
            held += len(values[b])
            b += 1
        yield values[a:b]
        a = b


def with_media(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_bytes (of the text in UTF-8; null counts as empty) and media: a JPEG that holds the text, padded with bytes 0 to a positive multiple of 64.

    Each row gives an image by itself, with null and repeated ids too; texts of any length are
    stored whole. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    df = docs.select(*keep, F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("_bytes"))

    def run(batches):
        for batch in batches:
            raw = batch.column(len(keep)).to_pylist()
            sizes = [len(x) for x in raw]
            media = [m for part in _bounded([x + bytes(-len(x) % BLOCK or (0 if x else BLOCK)) for x in raw]) for m in encode(part)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])

    types = dict(df.dtypes)
    return df.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_bytes long, media binary")


_FEATURES = {"width": pa.int32(), "height": pa.int32(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def _features_of(media: list[bytes]) -> list[tuple]:
    """The features of some images. One that can not be read has its bytes' length and hash alone."""
    try:
        heads, blocks = coefficients(media)
    except Exception:  # whatever a foreign or broken image makes the parser say
        if len(media) > 1:
            return [x for m in media for x in _features_of([m])]
        return [(None, None, None, None, None, len(media[0]), hashlib.sha256(media[0]).hexdigest(), None)]
    out = []
    for head, own, m in zip(heads, blocks, media, strict=True):
        payload, w, h = payload_of(head, own), head["width"], head["height"]
        said = (None,) * 3 if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]))
        out.append((w, h, *said, len(m), hashlib.sha256(m).hexdigest(), f"{w}x{h}:{thumbnail_hash(thumbnail(head, own))}"))
    return out


def media_features(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """``keep`` and, read from the media column: width, height, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature ("WxH:hash of the thumbnail").

    Null media gives nulls. A baseline greyscale image that with_media() did not make has no
    payload; any other image, colour or broken, has media_bytes and media_sha256 alone. Rows
    with null or repeated ids are read each by itself; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            media = batch.column(len(keep)).to_pylist()
            found = iter([x for part in _bounded([m for m in media if m is not None]) for x in _features_of(part)])
            rows = [(None,) * len(_FEATURES) if m is None else next(found) for m in media]
            cols = zip(*rows, strict=True) if rows else [[] for _ in _FEATURES]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(list(c), k) for c, k in zip(cols, _FEATURES.values(), strict=True)], names=[*keep, *_FEATURES])

    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", width int, height int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select(*keep, "media").mapInArrow(run, schema)
