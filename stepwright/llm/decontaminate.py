"""Benchmark decontamination by a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item; an item with
fewer words, but not none, is one window. A window occurs in a document only
if all its words do, so one necessary token is enough as its prefix: its
rarest word by document frequency over all documents (ties by the word). The
join of document words with prefix words yields candidates (position, window);
the offset of the prefix word in the window bounds where the window can start
and, with its length, whether it fits in the document. Candidates are verified
word by word over the item-sized window.

The benchmark is taken in blocks of at most ``block_bytes`` of text; each block
is sent to all tasks, and documents pass by it without a shuffle. Beyond one
block, the hits of all blocks meet by a digest of the text.

Defined cases: a null text has no words, in documents and in items. Windows of
several items, or of one item repeated, are matched once and counted for each
distinct item_id as a string; a null item_id counts as ''. Repeated documents
are judged row by row. Columns beside doc_id and the text are passed through by
``remove_contaminated`` and ignored otherwise. An empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialize, text_or_empty, values_of

WINDOW = 10
#: A block of this size takes about half a gigabyte of the driver when it is indexed.
BLOCK_BYTES = 4 << 20

#: ASCII letters to lower case; what is neither a digit, a letter nor above 0x7F to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def item_windows(items, window: int = WINDOW) -> dict[tuple, set[str]]:
    """Each window (a tuple of words) with the item ids that have it."""
    found = defaultdict(set)
    for item_id, text in items:
        w = words_of(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            found[tuple(w[i : i + n])].add("" if item_id is None else str(item_id))
    return found


class PrefixIndex:
    """The windows of a block of items by their rarest word."""

    def __init__(self, items, frequency: dict[bytes, int], window: int = WINDOW):
        windows = item_windows(items, window)
        self.ids = {w: i for i, w in enumerate(sorted({w for x in windows for w in x}))}
        self.owners, self.by_word = [], defaultdict(list)
        for x, owners in sorted(windows.items()):
            offset = min(range(len(x)), key=lambda k: (frequency.get(x[k], 0), x[k], k))
            self.by_word[self.ids[x[offset]]].append((offset, len(x), np.array([self.ids[w] for w in x], dtype=np.int32).tobytes(), len(self.owners)))
            self.owners.append(sorted(owners))
        self.is_prefix = np.zeros(len(self.ids) + 1, dtype=bool)
        self.is_prefix[list(self.by_word)] = True

    def match(self, words: list[bytes]) -> tuple[list[list[int]], list[str]]:
        """Merged hit ranges [start, stop) over ``words`` and the sorted ids of items with windows there."""
        n, get, none = len(words), self.ids.get, len(self.ids)
        ids = np.fromiter((get(w, none) for w in words), dtype=np.int32, count=n)
        found, spans = set(), []
        for p in np.flatnonzero(self.is_prefix[ids]).tolist():
            for offset, length, want, k in self.by_word[int(ids[p])]:
                start = p - offset
                if start >= 0 and start + length <= n and ids[start : start + length].tobytes() == want:
                    found.add(k)
                    spans.append((start, start + length))
        return merge_spans(spans), sorted({x for k in found for x in self.owners[k]})


def merge_spans(spans) -> list[list[int]]:
    """Overlapping or adjoining ranges as one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def word_frequency(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> dict[bytes, int]:
    """In how many documents each word of the vocabulary occurs, over all documents."""
    import pyarrow as pa

    known = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def count(batches):
        c, have = Counter(), known.value
        for b in batches:
            for s in values_of(b.column(0)):
                c.update(have.intersection(words_of(s)))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(c), pa.binary()), "n": pa.array(list(c.values()), pa.int64())})

    counts = map_arrow(docs.select(F.col(text)), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {bytes(r["word"]): r["n"] for r in counts.collect()}  # as many rows as the block has words
    known.destroy()
    return found


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items as lists of (item_id, text), each of about ``block_bytes`` at most."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item_id"), text_or_empty().alias("text"))
    size = b.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    k = max(1, -(-2 * size // block_bytes) if size > block_bytes else 1)
    for i in range(k):
        part = b if k == 1 else b.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == i)
        yield k, [(r["item_id"], r["text"]) for r in part.collect()]


_MATCH = "n_words long, spans array<array<long>>, items array<string>"


def _match_block(docs: DataFrame, items, text: str, window: int, keep: str | None, only_hits: bool) -> DataFrame:
    import pyarrow as pa

    spark = docs.sparkSession
    vocabulary = {w for x in item_windows(items, window) for w in x}
    index = spark.sparkContext.broadcast(PrefixIndex(items, word_frequency(docs, vocabulary, text) if vocabulary else {}, window))

    def match(batches):
        found = index.value
        for b in batches:
            n, spans, owners, rows = [], [], [], []
            for i, s in enumerate(values_of(b.column(0))):
                w = words_of(s)
                x, y = found.match(w)
                if x or not only_hits:
                    rows.append(i)
                    n.append(len(w))
                    spans.append(x)
                    owners.append(y)
            cols = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(owners, pa.list_(pa.string()))]
            names = ["n_words", "spans", "items"]
            if b.num_columns > 1:
                cols.insert(0, b.column(1).take(pa.array(rows, pa.int64())))
                names.insert(0, "key")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    if keep is None:
        return map_arrow(docs.select(text), match, _MATCH)
    kind = docs.schema[keep].dataType.simpleString()
    return map_arrow(docs.select(text, keep), match, f"key {kind}, {_MATCH}").withColumnRenamed("key", keep)


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: key, n_words, spans (merged hit ranges of words), items (ids, sorted as strings)."""
    d = docs.select(key, text)
    blocks = benchmark_blocks(benchmark, block_bytes)
    k, items = next(blocks)
    if k == 1:
        return _match_block(d, items, text, window, key, False)
    digest = F.sha2(text_or_empty(text), 256)
    by_text = materialize(d.select(digest.alias("digest"), text).dropDuplicates(["digest"]), "decon-texts")
    parts = []
    while items is not None:
        parts.append(materialize(_match_block(by_text, items, text, window, "digest", True), "decon-hits"))
        k, items = next(blocks, (k, None))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    ranges = F.array_sort(F.flatten(F.collect_list("spans")))
    merged = F.aggregate(
        ranges,
        F.array().cast("array<array<bigint>>"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (F.try_element_at(F.try_element_at(a, F.lit(-1)), F.lit(2)) >= x[0]),
            F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.array(F.try_element_at(F.try_element_at(a, F.lit(-1)), F.lit(1)), F.greatest(F.try_element_at(F.try_element_at(a, F.lit(-1)), F.lit(2)), x[1])))),
        ).otherwise(F.concat(a, F.array(x))),
    )
    hits = every.groupBy("digest").agg(merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    fold = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    n = F.regexp_count(F.translate(text_or_empty(text), fold, fold.lower()), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long")
    j = d.select(key, digest.alias("digest"), n.alias("n_words")).join(hits, "digest", "left")
    return j.select(key, "n_words", F.coalesce("spans", F.array().cast("array<array<bigint>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without a hit word, with all their columns."""
    import pyarrow as pa

    blocks = benchmark_blocks(benchmark)
    out, at = docs, docs.columns.index(text)
    for _, items in blocks:
        vocabulary = {w for x in item_windows(items, window) for w in x}
        if not vocabulary:
            continue
        index = docs.sparkSession.sparkContext.broadcast(PrefixIndex(items, word_frequency(docs, vocabulary, text), window))

        def keep(batches, index=index):
            found = index.value
            for b in batches:
                clean = [not found.match(words_of(s))[0] for s in values_of(b.column(at))]
                yield b.filter(pa.array(clean, pa.bool_()))

        out = map_arrow(out, keep, docs.schema)
    return out


def digest_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: which words of which documents are benchmark windows."""
    found = find_contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
), dw AS (
  SELECT rid, p, n, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), h AS (SELECT rid, item_id, p, n FROM dw JOIN iw USING (n, s)),
hw AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM h) GROUP BY rid),
hi AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
