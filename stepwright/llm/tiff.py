"""TIFF media columns: write byte payloads as TIFF, read any page of a TIFF column.

The reader walks the image directories of little- and big-endian files, takes
strips or tiles, decodes no compression, PackBits, LZW and deflate, undoes
horizontal differencing for 8-, 16- and 32-bit samples, and emits one row per
page. The writer makes the same kinds of file.

Defined cases: a null or empty media value has no page. A file that cannot be
read, or whose directory asks for more pixels than its strips or tiles can hold,
gives one row with page -1 and the reason in ``error``; pages before the fault are
kept. A directory that was walked before ends the walk. Other columns
of the table can be carried along by name.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialize, text_or_empty, values_of

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Sizes of the TIFF field types, and the tags in use.
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325

#: Bytes that a codec makes of one at most: a PackBits run of 128 takes two bytes, a deflate match of 258 bytes two bits, an LZW code of 12 bits names 3,840.
MOST_EXPANSION = {NONE: 1, PACKBITS: 64, LZW: 2560, DEFLATE: 1032, OLD_DEFLATE: 1032}

ROW_BYTES = 64
PAGE_ROWS = 2048
STRIP_ROWS = 512
LEVEL = 6


def packbits_decode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        c = data[i]
        i += 1
        if c < 128:
            out += data[i : i + c + 1]
            i += c + 1
        elif c > 128:
            out += data[i : i + 1] * (257 - c)
            i += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), data[i]))
            i = j
            continue
        while j < n and j - i < 128 and (j + 1 >= n or data[j] != data[j + 1]):
            j += 1
        out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bit first, width raised one code early."""
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, last, width, acc, held = [], None, 9, 0, 0
    for byte in data:
        acc, held = (acc << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code = acc >> held
        acc &= (1 << held) - 1
        if code == 256:
            del table[258:]
            last, width = None, 9
            continue
        if code == 257:
            break
        if code < len(table):
            entry = table[code]
        elif last is not None and code == len(table):
            entry = last + last[:1]
        else:
            raise ValueError("LZW code out of order")
        out.append(entry)
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes, width, acc, held, out = {bytes((i,)): i for i in range(256)}, 9, 0, 0, bytearray()

    def put(code):
        nonlocal acc, held
        acc, held = (acc << width) | code, held + width
        while held >= 8:
            held -= 8
            out.append((acc >> held) & 255)
        acc &= (1 << held) - 1

    put(256)
    n_codes, w = 258, b""
    for i in range(len(data)):
        x = w + data[i : i + 1]
        if x in codes:
            w = x
            continue
        put(codes[w])
        codes[x] = n_codes
        n_codes += 1
        if n_codes == (1 << width) and width < 12:
            width += 1
        if n_codes == 4095:
            put(256)
            codes, n_codes, width = {bytes((k,)): k for k in range(256)}, 258, 9
        w = data[i : i + 1]
    if w:
        put(codes[w])
        n_codes += 1
        if n_codes == (1 << width) and width < 12:
            width += 1
    put(257)
    if held:
        out.append((acc << (8 - held)) & 255)
    return bytes(out)


def decompress(data: bytes, kind: int, most: int = 0) -> bytes:
    if kind == NONE:
        return data
    if kind == PACKBITS:
        return packbits_decode(data)
    if kind == LZW:
        return lzw_decode(data)
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    raise ValueError(f"compression {kind} is not supported")


def compress(data: bytes, kind: int, level: int = LEVEL) -> bytes:
    if kind == NONE:
        return data
    if kind == PACKBITS:
        return packbits_encode(data)
    if kind == LZW:
        return lzw_encode(data)
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, level)
    raise ValueError(f"compression {kind} is not supported")


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, strip_rows: int = STRIP_ROWS, big_endian: bool = False, planar: int = 1) -> bytes:
    """A TIFF of unsigned pages (height, width, samples); tile = (length, width)."""
    e = ">" if big_endian else "<"
    out = bytearray((b"MM" if big_endian else b"II") + struct.pack(e + "HI", 42, 0))
    link = 4
    for page in pages:
        page = page.reshape(page.shape[0], page.shape[1], -1)
        height, width, samples = page.shape
        kind = np.dtype(page.dtype).newbyteorder(e)
        planes = [page] if planar == 1 else [page[:, :, k : k + 1] for k in range(samples)]
        offsets, counts = [], []
        th, tw = tile or (min(strip_rows, height), width)
        for plane in planes:
            for y in range(0, height, th):
                for x in range(0, width, tw):
                    part = plane[y : y + th, x : x + tw]
                    if tile:
                        part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
                    if predictor == 2:
                        part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                    data = compress(part.astype(kind).tobytes(), compression)
                    offsets.append(len(out))
                    counts.append(len(data))
                    out += data
        tags = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [page.dtype.itemsize * 8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [planar]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [tw]), (TILE_LENGTH, 4, [th]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [th]), (STRIP_COUNTS, 4, counts)]
        entries = []
        for tag, t, values in sorted(tags):
            raw = struct.pack(f"{e}{len(values)}{'HI'[t == 4]}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                at = len(out)
                out += raw
                raw = struct.pack(e + "I", at)
            entries.append(struct.pack(e + "HHI", tag, t, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(e + "I", out, link, len(out))
        out += struct.pack(e + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def _fields(data: bytes, e: str, at: int) -> tuple[dict, int]:
    """The tags of the directory at an offset and where the next one lies."""
    (n,) = struct.unpack_from(e + "H", data, at)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(e + "HHI", data, at + 2 + 12 * k)
        size = TYPE_SIZES.get(kind, 0) * count
        where = at + 10 + 12 * k
        if size > 4:
            (where,) = struct.unpack_from(e + "I", data, where)
        if kind in (1, 3, 4) and count:
            tags[tag] = list(struct.unpack_from(f"{e}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", data, where))
    return tags, struct.unpack_from(e + "I", data, at + 2 + 12 * n)[0]


def read_pages(data: bytes):
    """Each page as (facts, pixels): pixels of shape (height, width, samples)."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF")
    e = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(e + "I", data, 4)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        tags, following = _fields(data, e, at)
        one = lambda t, default, tags=tags: tags.get(t, [default])[0]
        width, height, samples = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1)
        bits, kind, predictor, planar = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
        if bits not in (8, 16, 32) or predictor not in (1, 2):
            raise ValueError(f"{bits} bits with predictor {predictor} are not supported")
        tiled = TILE_OFFSETS in tags
        th, tw = (one(TILE_LENGTH, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
        offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
        if width < 1 or height < 1 or samples < 1 or th < 1 or tw < 1:
            raise ValueError("a page without pixels")
        planes = 1 if planar == 1 else samples
        if not len(offsets) == len(counts) == planes * -(-height // th) * -(-width // tw):
            raise ValueError("the page has not got the strips or tiles that its size asks for")
        most = MOST_EXPANSION.get(kind, 1)
        if width * height * samples * (bits // 8) > most * max(1, sum(counts)) or th * tw * (samples if planar == 1 else 1) * (bits // 8) > most * max(1, max(counts)):
            raise ValueError("the page is larger than its stored bytes can be")
        dtype, per = np.dtype(f"{e}u{bits // 8}"), samples if planar == 1 else 1
        sizes = [(th if tiled else min(th, height - y)) * tw * per * dtype.itemsize for _ in range(planes) for y in range(0, height, th) for _ in range(0, width, tw)]
        parts = []
        for where, stored, size in zip(offsets, counts, sizes):  # before the page is allocated: its size is only claimed until its parts are there
            parts.append(decompress(data[where : where + stored], kind, size))
            if len(parts[-1]) < size:
                raise ValueError("a strip or tile is shorter than its page asks for")
        pixels, k = np.zeros((height, width, samples), dtype=dtype.newbyteorder("=")), 0
        for plane in range(planes):
            for y in range(0, height, th):
                for x in range(0, width, tw):
                    raw, parts[k] = parts[k], b""
                    rows = th if tiled else min(th, height - y)
                    part = np.frombuffer(raw, dtype=dtype, count=rows * tw * per).reshape(rows, tw, per).astype(pixels.dtype)
                    if predictor == 2:
                        part = np.cumsum(part, axis=1, dtype=pixels.dtype)
                    into = pixels[y : y + th, x : x + tw] if planar == 1 else pixels[y : y + th, x : x + tw, plane : plane + 1]
                    into[:] = part[: into.shape[0], : into.shape[1]]
                    k += 1
        yield {"width": width, "height": height, "samples": samples, "bits": bits, "compression": kind, "predictor": predictor, "parts": len(offsets), "tiled": tiled}, pixels
        at = following


_PAGE = "page int, width long, height long, samples int, bits int, compression int, predictor int, parts int, tiled boolean, media_sha256 string, pixels binary, error string"


def explode_pages(df: DataFrame, media: str = "media", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per page of each TIFF in the column: the carried columns and _PAGE; pages of a file follow one another."""
    import pyarrow as pa

    facts = [("page", pa.int32()), ("width", pa.int64()), ("height", pa.int64()), ("samples", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("parts", pa.int32()), ("tiled", pa.bool_()), ("media_sha256", pa.string()), ("pixels", pa.binary()), ("error", pa.string())]

    def rows_of(data):
        digest, page = hashlib.sha256(data).hexdigest(), 0
        try:
            for f, pixels in read_pages(data):
                yield {**f, "page": page, "media_sha256": digest, "pixels": pixels.tobytes()}
                page += 1
        except (ValueError, KeyError, IndexError, TypeError, OverflowError, MemoryError, struct.error, zlib.error) as x:
            yield {"page": -1, "media_sha256": digest, "error": str(x)[:200] or type(x).__name__}

    def explode(batches):
        for b in batches:
            out, of, held = {k: [] for k, _ in facts}, [], 0

            def emit(out, of, b=b):
                cols = [b.column(i).take(pa.array(of, pa.int64())) for i in range(1, b.num_columns)]
                return pa.RecordBatch.from_arrays([*cols, *(pa.array(out[k], t) for k, t in facts)], names=[*carry, *(k for k, _ in facts)])

            for i, data in enumerate(values_of(b.column(0))):
                for row in rows_of(data) if data else ():
                    for k in out:
                        out[k].append(row.get(k))
                    of.append(i)
                    held += len(row.get("pixels") or b"")
                    if held > 16 << 20:
                        yield emit(out, of)
                        out, of, held = {k: [] for k, _ in facts}, [], 0
            if of:
                yield emit(out, of)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    return map_arrow(df.select(media, *carry), explode, f"{kinds}, {_PAGE}" if carry else _PAGE)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the text padded with bytes 0 to a positive multiple of ROW_BYTES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % ROW_BYTES or (ROW_BYTES if not raw else 0))


def store_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a grey TIFF, ROW_BYTES wide, PAGE_ROWS rows a page."""
    import pyarrow as pa

    def encode(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                n, media = [], []
                for t in part.column(1).to_pylist():
                    size, raw = payload_of(t)
                    a = np.frombuffer(raw, dtype=np.uint8).reshape(-1, ROW_BYTES, 1)
                    n.append(size)
                    media.append(write_tiff([a[y : y + PAGE_ROWS] for y in range(0, len(a), PAGE_ROWS)]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text")), encode, "doc_id long, n_bytes long, media binary")


def fold_payloads(pages: DataFrame) -> DataFrame:
    """Per file, from its pages in order: digests of the payload and a feature string of counts."""
    import pyarrow as pa

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def fold(batches):
        head, out = None, []

        def close():
            doc_id, n_bytes, media_bytes, digest, sha, size, tail, hist, turns, n_pages = head
            feature = json.dumps({"pages": n_pages, "rows": size // ROW_BYTES, "bands": hist.reshape(16, 16).sum(axis=1).tolist(), "levels": int((hist > 0).sum()), "sum": int((hist * np.arange(256)).sum()), "turns": turns}, separators=(",", ":"))
            out.append((doc_id, n_bytes, size, sha.hexdigest(), zlib.crc32(tail[-64:]), media_bytes, digest, feature))

        for b in batches:
            for doc_id, n_bytes, media_bytes, page, digest, pixels, error in zip(*map(values_of, b.columns)):
                if error is not None:
                    raise ValueError(f"the stored file of {doc_id} cannot be read: {error}")
                if page == 0:
                    if head is not None:
                        close()
                    head = [doc_id, n_bytes, media_bytes, digest, hashlib.sha256(), 0, b"", np.zeros(256, dtype=np.int64), 0, 0]
                a = np.frombuffer(pixels, dtype=np.uint8)
                head[4].update(pixels)
                head[5] += len(pixels)
                head[6] = (head[6] + pixels[-64:])[-64:]
                head[7] += np.bincount(a, minlength=256)
                head[8] += int((a[1:] != a[:-1]).sum())
                head[9] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                out = []
        if head is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return map_arrow(pages.select("doc_id", "n_bytes", "media_bytes", "page", "media_sha256", "pixels", "error"), fold, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every text as a TIFF, stored, read back page by page and measured."""
    stored = materialize(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")), "tiff")
    stored = stored.withColumn("media_bytes", F.octet_length("media").cast("long"))
    return fold_payloads(explode_pages(stored, "media", ("doc_id", "n_bytes", "media_bytes")))
