"""TIFF as a column: writing payloads as TIFF files, and reading any baseline TIFF page by page.

Reader: both byte orders, classic and Big TIFF; the chain of image directories is walked (a directory met twice ends
it); strips and tiles, chunky or planar; compressions none (1), LZW (5), deflate (8 and 32946) and PackBits (32773); predictors none
(1), horizontal (2, for 8, 16 and 32 bits) and floating point (3); samples of 1 to 64 bits are given as unpacked bytes of
the file's sample width, little-endian, bit samples as whole bytes. One row comes out for each page.

Defined results: a null, empty or broken file gives one row with page null and `error` set; a broken page gives its row
with `error` set and no pixels, and the pages after it still come. Extra columns pass through the writer and reader.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import dotted, extended, undotted

#: Fixed values of the format: tag numbers, compressions, and bytes of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS, STRIP_SIZE, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_SIZE, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: No page may say it has more samples than this (a guard against damaged sizes).
MOST_SAMPLES = 1 << 31


# ---- codecs ---------------------------------------------------------------------------------------


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def packbits_encode(row: bytes) -> bytes:
    """Runs of three and more as repeats, the rest as literals."""
    out, at, n = bytearray(), 0, len(row)
    lit = 0
    while at < n:
        end = at + 1
        while end < n and end - at < 128 and row[end] == row[at]:
            end += 1
        if end - at >= 3:
            while lit < at:
                m = min(128, at - lit)
                out.append(m - 1)
                out += row[lit : lit + m]
                lit += m
            out.append(257 - (end - at))
            out.append(row[at])
            lit = end
        at = end
    while lit < n:
        m = min(128, n - lit)
        out.append(m - 1)
        out += row[lit : lit + m]
        lit += m
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, one code early in growing."""
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, before = [], b""
    acc = bits = made = 0
    wide = 9
    for byte in data:
        acc, bits = (acc << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < wide:
            continue
        bits -= wide
        code = acc >> bits & ((1 << wide) - 1)
        if code == 257 or made >= size:
            break
        if code == 256:
            del table[258:]
            wide, before = 9, b""
            continue
        if code < len(table):
            own = table[code]
        elif code == len(table) and before:
            own = before + before[:1]
        else:
            raise ValueError("LZW code out of range")
        if before and len(table) < 4096:
            table.append(before + own[:1])
            if len(table) + 1 >= 1 << wide and wide < 12:
                wide += 1
        out.append(own)
        made += len(own)
        before = own
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    table: dict[bytes, int] = {}
    out, acc, bits, wide = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal acc, bits
        acc, bits = acc << wide | code, bits + wide
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    def fresh() -> None:
        nonlocal wide
        put(256)
        table.clear()
        table.update((bytes((i,)), i) for i in range(256))
        wide = 9

    fresh()
    own, top = b"", 258
    for i in range(len(data)):
        more = own + data[i : i + 1]
        if more in table:
            own = more
            continue
        put(table[own])
        table[more] = top
        top += 1
        if top == 4094:
            fresh()
            top = 258
        elif top >= 1 << wide:
            wide += 1
        own = data[i : i + 1]
    if own:
        put(table[own])
        top += 1
        if top >= 1 << wide and wide < 12:
            wide += 1
    put(257)
    if bits:
        out.append(acc << (8 - bits) & 255)
    return bytes(out)


def decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = data
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression == PACKBITS:
        out = packbits_decode(data, size)
    else:
        raise ValueError(f"compression {compression}")
    if len(out) < size:
        raise ValueError(f"{len(out)} bytes where {size} belong")
    return out[:size]


# ---- reader ---------------------------------------------------------------------------------------


@dataclass
class Page:
    number: int
    width: int = 0
    height: int = 0
    samples: int = 1
    bits: int = 8
    compression: int = NONE
    predictor: int = 1
    photometric: int = 1
    tiled: bool = False
    parts: int = 0
    pixels: bytes | None = None
    error: str | None = None


def _unpredict(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """block: rows x pixels x samples, in the file's byte order."""
    if predictor == 1:
        return block
    if predictor == 2:
        if block.dtype.kind == "f":
            block = block.view(block.dtype.str.replace("f", "u"))
        native = block.astype(block.dtype.newbyteorder("="))
        return np.cumsum(native, axis=1, dtype=native.dtype)
    if predictor == 3:  # byte planes, most significant first, differenced along the row
        rows, cols, samples = block.shape
        wide = block.dtype.itemsize
        raw = np.ascontiguousarray(block).view(np.uint8).reshape(rows, wide * cols, samples)
        flat = raw.reshape(rows, -1)
        flat = np.cumsum(flat.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, wide, cols * samples)
        return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(f">u{wide}").reshape(rows, cols, samples)
    raise ValueError(f"predictor {predictor}")


def pages(data: bytes) -> Iterator[Page]:
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8:
        raise ValueError("not a TIFF file")
    magic = struct.unpack_from(f"{order}H", data, 2)[0]
    if magic == 42:
        big, at = False, struct.unpack_from(f"{order}I", data, 4)[0]
    elif magic == 43:
        big, at = True, struct.unpack_from(f"{order}Q", data, 8)[0]
    else:
        raise ValueError("not a TIFF file")
    seen, number = set(), 0
    while at and at not in seen:
        seen.add(at)
        page = Page(number)
        following = 0
        try:
            tags, following = _directory(data, at, order, big)
            _fill(page, tags, data, order)
        except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
            page.error, page.pixels = f"{type(e).__name__}: {e}", None
        yield page
        at, number = following, number + 1


def _directory(data: bytes, at: int, order: str, big: bool) -> tuple[dict[int, list], int]:
    head, entry, word = ("Q", 20, "Q") if big else ("H", 12, "I")
    n = struct.unpack_from(order + head, data, at)[0]
    at += struct.calcsize(head)
    room = struct.calcsize(word)
    tags: dict[int, list] = {}
    for k in range(n):
        own = at + k * entry
        tag, kind, count = struct.unpack_from(f"{order}HH{word}", data, own)
        code = _TYPES.get(kind)
        if code is None:
            continue
        value = own + 4 + room
        size = count * struct.calcsize(code)
        if size > len(data):
            raise ValueError(f"tag {tag}: {count} values")
        if size > room:
            value = struct.unpack_from(order + word, data, value)[0]
        tags[tag] = list(struct.unpack_from(f"{order}{count}{code}", data, value))
    return tags, struct.unpack_from(order + word, data, at + n * entry)[0]


def _fill(page: Page, tags: dict[int, list], data: bytes, order: str) -> None:
    one = lambda tag, default=None: tags[tag][0] if default is None or tag in tags else default
    page.width, page.height, page.samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    page.compression, page.predictor, page.photometric = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PHOTOMETRIC, 1)
    bits = set(tags.get(BITS, [1]))
    if len(bits) != 1:
        raise ValueError("samples of different widths")
    page.bits = bits.pop()
    page.tiled = TILE_AT in tags
    if page.width * page.height * page.samples > MOST_SAMPLES:
        raise ValueError("too large")
    planar = one(PLANAR, 1) == 2 and page.samples > 1
    deep = 1 if planar else page.samples
    if page.tiled:
        w, h, at, sizes = one(TILE_W), one(TILE_H), tags[TILE_AT], tags[TILE_SIZE]
    else:
        w, h, at, sizes = page.width, min(one(ROWS, page.height), page.height) or 1, tags[STRIP_AT], tags.get(STRIP_SIZE) or [len(data)]
    across, down = -(-page.width // w) if w else 0, -(-page.height // h)
    page.parts = len(at)
    kind = np.dtype(f"{order}{'f' if one(FORMAT, 1) == 3 and page.bits >= 32 else 'u'}{max(1, page.bits // 8)}")
    if page.bits not in (1, 2, 4, 8, 16, 32, 64):
        raise ValueError(f"{page.bits} bits")
    image = None
    for plane in range(page.samples if planar else 1):
        for k in range(across * down):
            y, x = k // across * h, k % across * w
            rows = h if page.tiled else min(h, page.height - y)
            line = -(-w * deep * page.bits // 8)
            n = plane * across * down + k
            raw = decode(bytes(data[at[n] : at[n] + sizes[n]]), page.compression, rows * line)
            if page.bits < 8:
                raw = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(rows, -1, page.bits)
                raw = raw @ (1 << np.arange(page.bits - 1, -1, -1)).astype(np.uint8)
                block = raw[:, : w * deep].reshape(rows, w, deep)
            else:
                block = np.frombuffer(raw, kind).reshape(rows, w, deep)
            block = _unpredict(block, page.predictor, order)
            block = block.astype(block.dtype.newbyteorder("<"))
            if image is None:
                image = np.zeros((page.height, page.width, page.samples), block.dtype)
            tall, wide = min(rows, page.height - y), min(w, page.width - x)
            image[y : y + tall, x : x + wide, plane : plane + deep] = block[:tall, :wide]
    page.pixels = b"" if image is None else image.tobytes()


# ---- writer ---------------------------------------------------------------------------------------


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows: int = 64, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian classic TIFF of 8-bit pages (height x width x samples), in strips of `rows` or in tiles."""
    out = bytearray(b"II\x2a\x00\x00\x00\x00\x00")
    link = 4
    for image in images:
        height, width, samples = image.shape
        th, tw = tile or (rows, width)
        at, sizes = [], []
        for y in range(0, height, th):
            for x in range(0, width, tw):
                block = image[y : y + th, x : x + tw]
                if tile:
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((block.shape[0], 1, samples), np.uint8))
                raw = np.ascontiguousarray(block, np.uint8)
                if compression in (DEFLATE, OLD_DEFLATE):
                    own = zlib.compress(raw.tobytes(), 6)
                elif compression == LZW:
                    own = lzw_encode(raw.tobytes())
                elif compression == PACKBITS:
                    own = b"".join(packbits_encode(r.tobytes()) for r in raw)
                else:
                    own = raw.tobytes()
                at.append(len(out))
                sizes.append(len(own))
                out += own
        out += b"\0" * (len(out) % 2)
        tags = {WIDTH: ("I", [width]), HEIGHT: ("I", [height]), BITS: ("H", [8] * samples), COMPRESSION: ("H", [compression]), PHOTOMETRIC: ("H", [2 if samples == 3 else 1]), SAMPLES: ("H", [samples]), PLANAR: ("H", [1]), PREDICTOR: ("H", [predictor])}
        tags |= {TILE_W: ("I", [tw]), TILE_H: ("I", [th]), TILE_AT: ("I", at), TILE_SIZE: ("I", sizes)} if tile else {STRIP_AT: ("I", at), ROWS: ("I", [th]), STRIP_SIZE: ("I", sizes)}
        entries = b""
        for tag in sorted(tags):
            code, values = tags[tag]
            raw = struct.pack(f"<{len(values)}{code}", *values)
            if len(raw) > 4:
                place = struct.pack("<I", len(out))
                out += raw + b"\0" * (len(raw) % 2)
                raw = place
            entries += struct.pack("<HHI", tag, 3 if code == "H" else 4, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    if len(out) >= 1 << 32:
        raise ValueError("a classic TIFF ends at 4 GB")
    return bytes(out)


# ---- columns --------------------------------------------------------------------------------------

_PAGE = "page int, width long, height long, samples int, bits int, compression int, predictor int, tiled boolean, parts int, pixels binary, error string"
_NAMES = [x.split()[0] for x in _PAGE.split(", ")]
#: Samples in a row of a stored text: 64 pixels of three.
ROW = 192
#: Rows of a page at most; longer payloads have more pages.
PAGE_ROWS = 4096


def _schema(df: DataFrame, more: str, drop: list[str]) -> tuple[list[str], StructType]:
    names = [c for c in df.columns if c not in drop]
    return names, extended(df, more, names)


def store_texts(docs: DataFrame, compression: int = DEFLATE, predictor: int = 1) -> DataFrame:
    """All columns of `docs` with n_bytes and media: the text's UTF-8 bytes, padded with spaces to rows of 192, as pages of 64 RGB pixels across."""
    docs = undotted(docs)
    names, schema = _schema(docs, "n_bytes long, media binary", ["n_bytes", "media"])

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                n, media = [], []
                for t in part.column("text").to_pylist():
                    raw = (t or "").encode("utf-8")
                    n.append(len(raw))
                    raw += b" " * (-len(raw) % ROW or (ROW if not raw else 0))
                    image = np.frombuffer(raw, np.uint8).reshape(-1, 64, 3)
                    media.append(write([image[y : y + PAGE_ROWS] for y in range(0, len(image), PAGE_ROWS)], compression, predictor))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=[*names, "n_bytes", "media"])

    return dotted(docs.mapInArrow(run, schema))


def read_pages(files: DataFrame, media: str = "media") -> DataFrame:
    """One row for each page of each file in the binary column `media`, with the other columns beside it."""
    files = undotted(files)
    names, schema = _schema(files, _PAGE, _NAMES)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                try:
                    found = list(pages(b.column(media)[i].as_py() or b""))
                except (ValueError, struct.error) as e:
                    found = [Page(None, error=f"{e}")]  # type: ignore[arg-type]
                for p in found or [Page(None, error="no image directory")]:  # type: ignore[arg-type]
                    values = (p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.parts, p.pixels, p.error)
                    types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 1) for c in names), *(pa.array([v], t) for v, t in zip(values, types, strict=True))], names=[*names, *_NAMES])

    return dotted(files.mapInArrow(run, schema))


def page_features(pixels: bytes) -> str:
    """Mean, standard deviation, entropy in bits and a 64-bit mean hash over 64 runs of the samples, in their order."""
    a = np.frombuffer(pixels, np.uint8)
    if not len(a):
        return "empty"
    p = np.bincount(a, minlength=256) / len(a)
    p = p[p > 0]
    cells = np.array([c.mean() for c in np.array_split(a, 64) if len(c)])
    bits = "".join("1" if c > cells.mean() else "0" for c in cells)
    return f"{a.mean():.4f} {a.std():.4f} {-(p * np.log2(p)).sum():.4f} {int(bits, 2):016x}"


def digest_texts(docs: DataFrame, compression: int = DEFLATE, predictor: int = 1) -> DataFrame:
    """doc_id, n_bytes, media, and per document the payload read back from its pages, with its features.

    A document's pages lie next to each other in the reader's rows; they are joined in the task that read them."""
    stored = undotted(store_texts(docs, compression, predictor))
    names, schema = _schema(stored, "payload binary, feature string", ["payload", "feature"])

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                payload, feature = [], []
                for m in part.column("media").to_pylist():
                    found = list(pages(m))
                    bad = next((p.error for p in found if p.error), None)
                    if bad:
                        raise ValueError(bad)
                    payload.append(b"".join(p.pixels for p in found))
                    feature.append("|".join([f"{len(found)}x{found[0].width}", page_features(payload[-1])]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(payload, pa.binary()), pa.array(feature)], names=[*names, "payload", "feature"])

    return stored.mapInArrow(run, schema).select("doc_id", "n_bytes", "media", "payload", "feature")


