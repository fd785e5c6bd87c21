"""WARC archives of pages, with a two-level capture index.

Writing: each task writes the records of its rows to one archive, a gzip
member per record. Equal payloads of at least ``min_revisit`` bytes are stored
once; the other records revisit the one with the smallest page_id.

Index: captures are sorted by reversed-host URL key over the whole run. Each
task of the sorted data writes one index file of zlib blocks of
``block_lines`` captures, followed by that file's block directory (first key,
offset and length of each block). The driver keeps one entry per index file.
A lookup binary-searches the files, then the file's directory, and reads one
byte range of index and one of archive per capture.

Defined cases: null html is an empty payload. A null url gives a record without
target URI and the key ''. Payloads below ``min_revisit`` bytes are always
responses. Repeated rows that all carry the smallest page_id of their payload
are all responses; a null page_id never is the smallest unless all are null.
Columns beside page_id, url and html are ignored. An empty table gives no
archive and an empty index.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import struct
import uuid
import zlib
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attempt_name, few_tasks, fresh_dir, make_dir, map_arrow, materialize, open_store, values_of

MIN_REVISIT = 100
BLOCK_LINES = 2000
WARC_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FOOT = struct.Struct("<QI4s")
_MAGIC = b"CDX2"
_READ_AHEAD = 4 << 20

CAPTURE = "url_key string, page_id long, url string, record_type string, digest string, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Reversed-host key: http://www.a.example/x?q -> example,a)/x?q, lower-case host, no scheme, port 80/443 or www."""
    if not url:
        return ""
    rest = url.strip()
    try:
        parts = urlsplit(rest if "://" in rest else "http://" + rest)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return rest.lower()
    if host.startswith("www."):
        host = host[4:]
    key = ",".join(reversed(host.split(".")))
    if port and port not in (80, 443):
        key += f":{port}"
    return key + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def encode_record(page_id, url, payload: bytes, digest: str, refers_to=None, refers_url=None, revisit=False) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {WARC_DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_clean(refers_url)}")
    head.append(f"Content-Length: {len(body)}")
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def decode_record(member: bytes) -> dict:
    """Headers (lower-case names) and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record length does not match its header")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    declared = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    return {"fields": fields, "payload": payload, "declared": declared}


def with_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, and first_id/first_url where the row is a revisit.

    Payloads are grouped by digest with partial aggregation, so that a payload
    which a third of all rows share costs one row per task; rows meet their
    group in an equi-join whose hot keys the adaptive planner can split.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha2(F.col("payload"), 256))
    firsts = (
        p.filter(F.octet_length("payload") >= min_revisit)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))["url"].alias("first_url"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1 and first_id is not null")
        .drop("copies")
    )
    j = p.join(firsts, "digest", "left")
    again = F.col("first_id").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first_id"), F.lit(False))
    return j.select("page_id", "url", "payload", "digest", F.when(again, F.col("first_id")).alias("first_id"), F.when(again, F.col("first_url")).alias("first_url"))


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write the archives below ``folder``; one row per capture (CAPTURE)."""
    import pyarrow as pa

    make_dir(pages.sparkSession, folder)

    def write(batches):
        fs, base = open_store(folder)
        name, out, at = attempt_name("pages", ".warc.gz"), None, 0
        for b in batches:
            rows = {k: [] for k in ("url_key", "page_id", "url", "record_type", "digest", "file", "offset", "length")}
            for page_id, url, payload, digest, first, first_url in zip(*map(values_of, b.columns)):
                member = encode_record(page_id, url, payload, digest, first, first_url, first is not None)
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(member)
                for k, v in zip(rows, (url_key(url), page_id, url, "response" if first is None else "revisit", digest, name, at, len(member))):
                    rows[k].append(v)
                at += len(member)
            yield pa.RecordBatch.from_pydict(rows, schema=schema)
        if out is not None:
            out.close()

    schema = pa.schema([(k, pa.int64() if k in ("page_id", "offset", "length") else pa.string()) for k in ("url_key", "page_id", "url", "record_type", "digest", "file", "offset", "length")])
    return materialize(map_arrow(with_revisits(pages, min_revisit), write, CAPTURE), "captures")


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort captures by URL key into index files; one row per file: file, first_key, blocks, captures."""
    import pyarrow as pa

    spark = captures.sparkSession
    make_dir(spark, folder)
    columns = ["url_key", "page_id", "url", "record_type", "digest", "file", "offset", "length"]

    def write(batches):
        fs, base = open_store(folder)
        name, out, at, lines, directory, total = attempt_name("index", ".cdx"), None, 0, [], [], 0

        def flush():
            nonlocal out, at
            block = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode())
            if out is None:
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            out.write(block)
            directory.append((lines[0][0], at, len(block)))
            at += len(block)
            lines.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                lines.append(row)
                total += 1
                if len(lines) == block_lines:
                    flush()
        if lines:
            flush()
        if out is not None:
            foot = zlib.compress(json.dumps(directory).encode())
            out.write(foot + index_tail(at, len(foot)))
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "first_key": [directory[0][0]], "blocks": [len(directory)], "captures": [total]}, schema=schema)

    schema = pa.schema([("file", pa.string()), ("first_key", pa.string()), ("blocks", pa.int64()), ("captures", pa.int64())])
    order = ["url_key", "page_id", "file", "offset"]
    ranged = captures.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(map_arrow(ranged, write, "file string, first_key string, blocks long, captures long"), "index-files")


def index_tail(start: int, length: int) -> bytes:
    """The fixed-length end of an index file: where its directory lies."""
    return _FOOT.pack(start, length, _MAGIC)


def read_directory(fs, path: str) -> list:
    """[first key, offset, length] of each block of an index file, from its end."""
    with fs.open_input_file(path) as f:
        f.seek(f.size() - _FOOT.size)
        start, n, magic = _FOOT.unpack(f.read(_FOOT.size))
        if magic != _MAGIC:
            raise ValueError(f"{path} is not an index file")
        f.seek(start)
        return json.loads(zlib.decompress(f.read(n)))


def read_block(f, offset: int, length: int) -> list:
    f.seek(offset)
    return [json.loads(x) for x in zlib.decompress(f.read(length)).decode().split("\n")]


def scan_index(files: DataFrame, folder: str) -> DataFrame:
    """Every capture, from the blocks of the index files."""
    import pyarrow as pa

    kinds = [("url_key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]

    def read(batches):
        fs, base = open_store(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                blocks = read_directory(fs, f"{base}/{name}")
                with fs.open_input_file(f"{base}/{name}") as f:
                    for _, offset, length in blocks:
                        cols = list(zip(*read_block(f, offset, length)))
                        yield pa.RecordBatch.from_pydict({k: pa.array(c, t) for (k, t), c in zip(kinds, cols)})

    return map_arrow(files.select("file").repartition(files.sparkSession.sparkContext.defaultParallelism * 2), read, CAPTURE)


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """Fetch each capture's record: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Captures are dealt by range over (file, offset), so a task reads its
    archives forwards, in large pieces, and no archive is one task's alone.
    A revisit has its own bytes only: payload is null, length and digest are
    those of the full payload, from its headers.
    """
    import pyarrow as pa

    def read(batches):
        fs, base = open_store(folder)
        name, f, piece, at, size = None, None, b"", 0, 0
        for b in batches:
            rows = {k: [] for k in schema.names}
            for file, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f, piece, at = file, fs.open_input_file(f"{base}/{file}"), b"", 0
                if offset < at or offset + length > at + len(piece):
                    f.seek(offset)
                    piece, at = f.read(max(length, _READ_AHEAD)), offset
                r = decode_record(piece[offset - at : offset - at + length])
                h, payload = r["fields"], r["payload"]
                digest, kind = h["warc-payload-digest"].removeprefix("sha256:"), h["warc-type"]
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {file}@{offset} does not match its digest")
                page, ref = h.get("warc-page-id"), h.get("warc-refers-to-page-id")
                for k, v in zip(schema.names, (None if page is None else int(page), h.get("warc-target-uri"), payload if kind == "response" else None, r["declared"], digest, kind, None if ref is None else int(ref))):
                    rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=schema)
        if f is not None:
            f.close()

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    size = captures.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = few_tasks(captures.sparkSession, size, 64 << 20)  # by archive bytes: captures are so small that they would be put in one task
    ranged = captures.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return map_arrow(ranged, read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def lookup(urls: DataFrame, files: DataFrame, folder: str, column: str = "url") -> DataFrame:
    """Captures of each URL in ``urls``, by two binary searches and range reads.

    The driver holds one key per index file (as many as tasks wrote the index).
    A URL goes to each file that can hold its key, found by binary search over
    these; a file's URLs meet in one task, in key order, which searches the file's
    block directory and reads the blocks from there. A key with a third of all
    captures lies in many files, so in many tasks.
    """
    import pyarrow as pa

    entries = sorted((r["first_key"], r["file"]) for r in files.select("first_key", "file").collect())
    first_keys = [k for k, _ in entries]
    kinds = [("query", pa.string()), ("url_key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]

    def places(batches):
        for b in batches:
            rows = []
            for url in values_of(b.column(0)):
                key = url_key(url)
                first = max(0, bisect.bisect_left(first_keys, key) - 1)
                rows += [(url, key, i) for i in range(first, bisect.bisect_right(first_keys, key))]
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_pydict({"query": pa.array(cols[0], pa.string()), "url_key": pa.array(cols[1], pa.string()), "n": pa.array(cols[2], pa.int64())})

    def find(batches):
        fs, base = open_store(folder)
        n, f, blocks, held = None, None, [], {}
        for b in batches:
            out: list = []
            for url, key, i in zip(*map(values_of, b.columns)):
                if i != n:
                    if f is not None:
                        f.close()
                    n, path, held = i, f"{base}/{entries[i][1]}", {}
                    blocks, f = read_directory(fs, path), fs.open_input_file(path)
                j = max(0, bisect.bisect_left(blocks, key, key=lambda x: x[0]) - 1)
                held = {k: v for k, v in held.items() if k >= j}
                while j < len(blocks) and blocks[j][0] <= key:
                    if j not in held:
                        held = {k: v for k, v in held.items() if k >= j - 1} | {j: read_block(f, blocks[j][1], blocks[j][2])}
                    lines = held[j]
                    at = bisect.bisect_left(lines, key, key=lambda x: x[0])
                    while at < len(lines) and lines[at][0] == key:
                        out.append((url, *lines[at]))
                        at += 1
                    j += 1
                    if len(out) > 20_000:
                        yield batch(out)
                        out = []
            yield batch(out)
        if f is not None:
            f.close()

    def batch(rows):
        cols = list(zip(*rows)) or [()] * len(kinds)
        return pa.RecordBatch.from_pydict({k: pa.array(c, t) for (k, t), c in zip(kinds, cols)})

    asked = map_arrow(urls.select(F.col(column).cast("string")), places, "query string, url_key string, n long")
    return map_arrow(asked.repartition("n").sortWithinPartitions("n", "url_key"), find, "query string, " + CAPTURE)


def one_url_per_key(pages: DataFrame) -> DataFrame:
    """(url): for each key of the index, one URL that has it."""
    import pyarrow as pa

    def keys(batches):
        for b in batches:
            urls = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in urls], pa.string()), b.column(0)], names=["url_key", "url"])

    urls = pages.select(F.col("url").cast("string").alias("url")).distinct()
    return map_arrow(urls, keys, "url_key string, url string").groupBy("url_key").agg(F.min("url").alias("url")).select("url")


def archive(spark: SparkSession, pages: DataFrame, min_revisit: int = MIN_REVISIT) -> tuple[DataFrame, DataFrame, str]:
    """Write archives and index of ``pages`` to a fresh shared folder: (captures, index files, folder)."""
    folder = fresh_dir(spark, "warc")
    captures = write_archives(pages, folder, min_revisit)
    return captures, write_index(captures, folder), folder


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: archive every page, then look every URL key up in the index and read the records back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    _, files, folder = archive(spark, pages)
    captures = materialize(lookup(one_url_per_key(pages), files, folder), "found", few_tasks(spark, 0))
    found = read_records(captures, folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN NULL ELSE first_id END::BIGINT AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
