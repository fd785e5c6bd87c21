"""Exact substring dedup with difference-cover anchors.

A word goes if a window of ``window`` consecutive words that covers it starts
anywhere else too, in the same document or another.

Positions are taken modulo ``PERIOD``; the cover is a set of residues such that
any two positions have a common shift below the period that brings both onto
the cover. Anchors are hashes of ``window - PERIOD + 1`` words at cover
positions only. Two equal windows therefore share an anchor at the same offset
inside them. Step 1 finds the anchors that occur more than once. Step 2 extends
them: only windows that contain a repeated anchor within one period of their
start are hashed in full (128 bits), and those that occur more than once
are the repeated windows. Step 3 removes the words they cover. No step pairs
occurrences, so a passage of a million copies costs a million rows.

Documents are stored in chunks in the shared folder. A chunk asks about each
distinct hash that it has once, so a hot passage costs a row per chunk, and is
answered by one bit; the chunk's texts are read again, never shuffled.

Defined cases: null text has no words; texts shorter than a window keep all.
Repeated rows are documents of their own, so each repeats the other. doc_id may
be null or repeat. Other columns pass through ``dedup_substrings`` and are
ignored otherwise.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_tasks, map_arrow, materialize
from .shingles import plain_words, scramble, word_hashes

WINDOW = 35
#: A perfect difference set: each residue modulo 21 is a difference of two members.
PERIOD = 21
COVER = (0, 1, 6, 8, 18)

_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_M64 = (1 << 64) - 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    key = int(base)
    have = _POWERS.get(key)
    if have is None or len(have[0]) <= n:
        m = max(4096, 2 * n)
        inv = np.uint64(pow(int(base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m, base, dtype=np.uint64)]), dtype=np.uint64)
            down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m, inv, dtype=np.uint64)]), dtype=np.uint64)
        have = _POWERS[key] = (up, down)
    return have


def window_hashes(h: np.ndarray, width: int, base: np.uint64 = _B1) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` word hashes; equal runs, equal hashes."""
    n = len(h)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(base, n)
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * up[:n], dtype=np.uint64)])
    return scramble((total[width:] - total[: n - width + 1]) * down[: n - width + 1])


def anchor_positions(n: int, width: int) -> np.ndarray:
    """Cover positions at which a run of ``width`` words starts."""
    last = n - width + 1
    if last <= 0:
        return np.zeros(0, dtype=np.int64)
    p = (np.arange(0, last + PERIOD, PERIOD)[:, None] + np.array(COVER)).reshape(-1)
    return p[p < last]


def _starts(n: int, window: int, marked: np.ndarray) -> np.ndarray:
    """Starts of windows that hold a marked anchor position within one period of their start."""
    last = n - window + 1
    d = np.zeros(last + PERIOD + 1, dtype=np.int32)
    np.add.at(d, np.maximum(marked - PERIOD + 1, 0), 1)
    np.add.at(d, np.minimum(marked + 1, last), -1)
    return np.flatnonzero(np.cumsum(d[:last]) > 0)


def bits_of(bucket_key: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts in a sorted array of 64-bit values; buckets is a power of two."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    edges = np.arange(1, buckets, dtype=np.uint64) << shift if buckets > 1 else np.zeros(0, dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(bucket_key, edges), [len(bucket_key)]])


class Chunk:
    """A chunk of documents in one file of the shared folder, and what is computed from it alone.

    All steps compute hashes from the same file in the same order, so a step
    can answer another by one bit per distinct hash.
    """

    def __init__(self, texts: list, window: int):
        self.texts, self.window, self.width = texts, window, window - PERIOD + 1
        self.hashes = [word_hashes(plain_words(t)) for t in texts]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct anchors and whether each occurs more than once in the chunk."""
        self.positions = [anchor_positions(len(h), self.width) for h in self.hashes]
        found = [window_hashes(h, self.width)[p] for h, p in zip(self.hashes, self.positions)]
        values, self.anchor_of, counts = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
        return values, counts > 1

    def windows(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of windows next to repeated anchors: sorted distinct hashes, their second hashes, whether repeated here."""
        mark, at, self.starts, first, second = repeated[self.anchor_of] if len(repeated) else np.zeros(0, bool), 0, [], [], []
        for h, p in zip(self.hashes, self.positions):
            here = p[mark[at : at + len(p)]]
            at += len(p)
            s = _starts(len(h), self.window, here) if len(here) and len(h) >= self.window else np.zeros(0, np.int64)
            self.starts.append(s)
            if len(s):
                first.append(window_hashes(h, self.window)[s])
                second.append(window_hashes(h, self.window, _B2)[s])
        none = [np.zeros(0, np.uint64)]
        values, index, self.window_of, counts = np.unique(np.concatenate(first or none), return_index=True, return_inverse=True, return_counts=True)
        return values, np.concatenate(second or none)[index], counts > 1

    def covered(self, repeated: np.ndarray):
        """For each document, which of its words a repeated window covers."""
        mark, at = repeated[self.window_of] if len(repeated) else np.zeros(0, bool), 0
        for h, s in zip(self.hashes, self.starts):
            here = s[mark[at : at + len(s)]]
            at += len(s)
            d = np.zeros(len(h) + 1, dtype=np.int32)
            np.add.at(d, here, 1)
            np.add.at(d, here + self.window, -1)
            yield np.cumsum(d[:-1]) > 0


def write_chunk(folder: str, payload: list) -> str:
    """Store the rows of a chunk in the shared folder; the file's name."""
    import pickle

    import zstandard

    from .common import attempt_name, open_store

    fs, base = open_store(folder)
    name = attempt_name("chunk", ".zst")
    with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
        out.write(zstandard.ZstdCompressor(level=3).compress(pickle.dumps(payload, protocol=5)))
    return name


def read_chunk(folder: str, name: str) -> list:
    import pickle

    import zstandard

    from .common import open_store

    fs, base = open_store(folder)
    with fs.open_input_file(f"{base}/{name}") as f:
        return pickle.loads(zstandard.ZstdDecompressor().decompress(f.read()))


def _bucket_rows(name: str, values, second, multi, buckets: int):
    """Rows (chunk, bucket, first, second, multi) of the sorted values; bucket -1 stands for the chunk itself."""
    import pyarrow as pa

    cut = bits_of(values, buckets)
    rows = {"chunk": [name], "bucket": [-1], "first": [b""], "second": [b""], "multi": [b""]}
    for k in np.flatnonzero(np.diff(cut)).tolist():
        a, b = int(cut[k]), int(cut[k + 1])
        for key, v in zip(rows, (name, k, values[a:b].tobytes(), b"" if second is None else second[a:b].tobytes(), np.packbits(multi[a:b]).tobytes())):
            rows[key].append(v)
    return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("chunk", pa.string()), ("bucket", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("multi", pa.binary())]))


_ROWS = "chunk string, bucket long, first binary, second binary, multi binary"
_BITS = "chunk string, bucket long, bits binary"


def _answer(group: list):
    """One bit per value of each row of a bucket: does it occur more than once over all chunks?"""
    import pyarrow as pa

    first = [np.frombuffer(r[2], dtype=np.uint64) for r in group]
    second = [np.frombuffer(r[3], dtype=np.uint64) for r in group]
    multi = np.concatenate([np.unpackbits(np.frombuffer(r[4], dtype=np.uint8), count=len(f)).astype(bool) for r, f in zip(group, first)])
    v, w = np.concatenate(first), np.concatenate(second)
    order = np.lexsort((w, v)) if len(w) else np.argsort(v, kind="stable")
    s = v[order]
    same = s[1:] == s[:-1]
    if len(w):
        same &= w[order][1:] == w[order][:-1]
    many = multi[order]
    group_of = np.concatenate([[0], np.cumsum(~same)]) if len(s) else np.zeros(0, np.int64)
    size = np.bincount(group_of)
    flagged = np.bincount(group_of, weights=many)
    out = np.zeros(len(v), dtype=bool)
    out[order] = ((size > 1) | (flagged > 0))[group_of]
    ends = np.cumsum([len(f) for f in first])
    bits = [np.packbits(out[e - len(f) : e]).tobytes() for f, e in zip(first, ends)]
    return pa.RecordBatch.from_pydict({"chunk": [r[0] for r in group], "bucket": pa.array([r[1] for r in group], pa.int64()), "bits": pa.array(bits, pa.binary())})


def repeated_bits(rows: DataFrame) -> DataFrame:
    """Answer every row of (chunk, bucket, ...) with its bits; a bucket at a time."""

    def answer(batches):
        import pyarrow as pa

        now, group = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[1] < 0:
                    yield pa.RecordBatch.from_pydict({"chunk": [row[0]], "bucket": pa.array([-1], pa.int64()), "bits": pa.array([b""], pa.binary())})
                    continue
                if row[1] != now and group:
                    yield _answer(group)
                    group = []
                now = row[1]
                group.append(row)
        if group:
            yield _answer(group)

    spread = F.when(F.col("bucket") < 0, F.xxhash64("chunk")).otherwise(F.col("bucket"))
    return map_arrow(rows.withColumn("spread", spread).repartition("spread").drop("spread").sortWithinPartitions("bucket"), answer, _BITS)


def _by_chunk(bits: DataFrame, n_chunks: int) -> DataFrame:
    """Rows of bits with the rows of each chunk together, steps and buckets in order.

    The partitions are counted by chunks, not left to the planner: rows are a
    few bytes but stand for a chunk of text each.
    """
    return bits.repartition(max(1, 2 * n_chunks), "chunk").sortWithinPartitions("chunk", "step", "bucket").select("chunk", "step", "bits")


def _chunks_of(batches):
    """(chunk, [bits of step 1, bits of step 2]) from ordered rows; bits as bytes per row."""
    now, steps = None, ([], [])
    for b in batches:
        for chunk, step, bits in zip(*(c.to_pylist() for c in b.columns)):
            if chunk != now:
                if now is not None:
                    yield now, steps
                now, steps = chunk, ([], [])
            if bits:
                steps[step - 1].append(bits)
    if now is not None:
        yield now, steps


def _unpack(bits: list[bytes], values: np.ndarray, buckets: int) -> np.ndarray:
    """The answers of the buckets that the values fill, as one mask over the values."""
    sizes = [n for n in np.diff(bits_of(values, buckets)).tolist() if n]
    if len(sizes) != len(bits):
        raise ValueError("a chunk has not got the answers that it asked for")
    parts = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n) for x, n in zip(bits, sizes)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, dtype=bool)


def dedup_substrings(docs: DataFrame, text: str = "text", window: int = WINDOW, chunk_bytes: int = 24 << 20) -> DataFrame:
    """The documents with ``text`` cut to its kept words where any goes, and n_words, n_removed.

    A text that loses no word stays as it is. Columns n_words and n_removed of
    the input give way to the new ones.
    """
    docs = docs.drop("n_words", "n_removed")
    return _run(docs, text, window, chunk_bytes, digest=False)


def _run(docs: DataFrame, text: str, window: int, chunk_bytes: int, digest: bool) -> DataFrame:
    import pyarrow as pa

    from .common import fresh_dir, make_dir

    if window <= PERIOD:
        raise ValueError(f"window must be over {PERIOD} words")
    spark, folder = docs.sparkSession, fresh_dir(docs.sparkSession, "chunks")
    make_dir(spark, folder)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = 1 << max(6, min(20, (size >> 24).bit_length()))
    names, schema = docs.columns, docs.schema
    at = names.index(text)

    def first(batches):
        def emit(part):
            table = pa.Table.from_batches(part)
            c = Chunk(table.column(at).to_pylist(), window)
            values, multi = c.anchors()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            return _bucket_rows(write_chunk(folder, sink.getvalue().to_pybytes()), values, None, multi, buckets)

        part, held = [], 0
        for b in batches:
            step = max(1, min(b.num_rows, int(b.num_rows * chunk_bytes / max(1, b.nbytes))))
            for i in range(0, b.num_rows, step):
                piece = b.slice(i, step)
                if held and held + piece.nbytes > chunk_bytes:
                    yield emit(part)
                    part, held = [], 0
                part.append(piece)
                held += piece.nbytes
        if part:
            yield emit(part)

    def load(name):
        table = pa.ipc.open_stream(read_chunk(folder, name)).read_all()
        return table, Chunk(table.column(at).to_pylist(), window)

    def second(batches):
        for name, (bits, _) in _chunks_of(batches):
            _, c = load(name)
            values, _ = c.anchors()
            yield _bucket_rows(name, *c.windows(_unpack(bits, values, buckets)), buckets)

    def third(batches):
        for name, (anchor_bits, window_bits) in _chunks_of(batches):
            table, c = load(name)
            values, _ = c.anchors()
            values, _, _ = c.windows(_unpack(anchor_bits, values, buckets))
            kept, n, gone = [], [], []
            for t, cover in zip(c.texts, c.covered(_unpack(window_bits, values, buckets))):
                n.append(len(cover))
                gone.append(int(cover.sum()))
                if digest or gone[-1]:
                    w = plain_words(t)
                    kept.append(b" ".join([w[i] for i in np.flatnonzero(~cover).tolist()] if gone[-1] else w))
                else:
                    kept.append(None)
            if digest:
                out = pa.Table.from_arrays([table.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
            else:
                new = pa.array([t if k is None else k.decode("utf-8", "surrogatepass") for k, t in zip(kept, c.texts)], pa.string())
                out = table.set_column(at, text, new).append_column("n_words", pa.array(n, pa.int64())).append_column("n_removed", pa.array(gone, pa.int64()))
            yield from out.to_batches(max_chunksize=2000)

    asked = materialize(map_arrow(docs, first, _ROWS), "anchors")
    n_chunks = asked.filter("bucket = -1").count()
    few = few_tasks(spark, n_chunks * buckets, 4096)
    anchor_bits = materialize(repeated_bits(asked).withColumn("step", F.lit(1)), "anchor-bits", few)
    windows = materialize(map_arrow(_by_chunk(anchor_bits, n_chunks), second, _ROWS), "windows")
    window_bits = materialize(repeated_bits(windows).withColumn("step", F.lit(2)), "window-bits", few)
    if digest:
        kind = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    else:
        from pyspark.sql.types import LongType, StructField, StructType

        kind = StructType([*schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType())])
    return map_arrow(_by_chunk(anchor_bits.unionByName(window_bits), n_chunks), third, kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: words of repeated 35-word windows of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _run(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", WINDOW, 24 << 20, digest=True)


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT rid, p, md5(array_to_string(w[p : p + 34], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)
), r AS (SELECT rid, p FROM x JOIN (SELECT h FROM x GROUP BY h HAVING count(*) > 1) USING (h)),
g AS (SELECT DISTINCT rid, unnest(range(p, p + 35)) AS q FROM r),
a AS (SELECT rid, list(q) AS qs FROM g GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(qs), 0)::BIGINT AS n_removed,
       sha256(coalesce((SELECT string_agg(w[i], ' ' ORDER BY i) FROM (SELECT unnest(range(1, len(w) + 1)) AS i) WHERE qs IS NULL OR NOT list_contains(qs, i)), '')) AS kept_sha256
FROM d LEFT JOIN a USING (rid)
"""
