"""Ranked lexical search of all documents for each item: a join seeded by thresholds.

* **Index.** One pass counts the words of every document and stores, per document,
  those that some item may hold, with their occurrences: a fixed-size filter of hashed
  item terms decides, so what it lets pass beside them costs space, never a row.
* **Seeds.** For each term of a block of items the ``k`` largest impacts (what the
  term adds to a document's score) and their documents are stored, with the largest.
  An item's kth score is at least the kth impact of any of its terms; then the stored
  documents are scored exactly, and it is at least the kth of those scores.
* **Pruning.** An item's terms are ordered by their largest impact. The suffix whose
  largest impacts sum up to less than the item's threshold cannot lift a document into
  its ranking: documents that hold only such terms are no candidates.
* **Join.** Documents meet the essential terms of the block in each task. Of the
  candidates those that cannot reach the threshold with all that the suffix could add
  are left out, the others are scored exactly with all their terms. A task returns an
  item's ``k`` best at most, as the rest of its documents cannot be among the best.

Items come in blocks of at most ``block_terms`` different terms (one item at least), and
a block is all that is broadcast; each further block reads the index again.

Defined cases: a null or empty text has no terms; an item without terms, or whose terms
no document holds, has no rows. Each row of the items is ranked for itself, repeated ids
too; repeated documents are ranked row by row (equal scores by doc_id, null first).
Columns beside ids and texts are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, values_of
from .decontaminate import words_of

K = 10
#: Different terms of a block of items: a few MB when broadcast.
BLOCK_TERMS = 100_000
#: Bits of the filter of item terms; its size does not depend on the items.
FILTER_BITS = 1 << 22
#: Documents that a task scores side by side times items of the block.
CELLS = 1 << 21


def term_weight(n_docs: int, df: int) -> int:
    """Fixed formula: floor(1000 ln((2N + 2) / (2df + 1)))."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _bit(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) & (FILTER_BITS - 1)


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """A row per item with terms: rid, item_id, terms (distinct, sorted)."""
    import pyarrow as pa

    kind = items.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            terms = [sorted({w.decode() for w in words_of(s)}) for s in values_of(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(terms, pa.list_(pa.string()))], names=["rid", "item_id", "terms"])

    d = items.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("item_id"), F.col(text).alias("text"))
    return map_arrow(d, run, f"rid long, item_id {kind}, terms array<string>").filter(F.size("terms") > 0)


def term_filter(items: DataFrame) -> np.ndarray:
    """Which bits the terms of all items set; distinct bits come to the driver, never the terms."""
    import pyarrow as pa

    def run(batches):
        seen = np.zeros(FILTER_BITS, dtype=bool)
        for b in batches:
            for terms in values_of(b.column(0)):
                seen[[_bit(t.encode()) for t in terms]] = True
        yield pa.RecordBatch.from_pydict({"bits": pa.array([np.packbits(seen).tobytes()], pa.binary())})

    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in map_arrow(items.select("terms").coalesce(8), run, "bits binary").toLocalIterator():
        out |= np.frombuffer(r["bits"], dtype=np.uint8)
    return np.unpackbits(out).astype(bool)


def index_documents(docs: DataFrame, wanted: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document with an item's term (rid, doc_id, n, terms, tf), and one per batch with the batch's N and L."""
    import pyarrow as pa

    kind = docs.schema[key].dataType
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches):
        keep = np.unpackbits(bits.value).astype(bool)
        known: dict[bytes, bool] = {}
        for b in batches:
            at, sizes, terms, counts, n_docs, n_words = [], [], [], [], 0, 0
            for i, s in enumerate(values_of(b.column(2))):
                words = words_of(s)
                if not words:
                    continue
                n_docs, n_words = n_docs + 1, n_words + len(words)
                found = Counter(words)
                if len(known) > 200_000:
                    known.clear()
                for w in [w for w in found if w not in known]:
                    known[w] = bool(keep[_bit(w)])
                held = [w for w in found if known[w]]
                if held:
                    at.append(i)
                    sizes.append(len(words))
                    terms.append([w.decode() for w in held])
                    counts.append([found[w] for w in held])
            rows = pa.array(at, pa.int64())
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64())), none, none], names=_INDEX)
            total = [pa.array([x], pa.int64()) for x in (n_docs, n_words)]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, b.column(1).type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.string())), pa.nulls(1, pa.list_(pa.int64())), *total], names=_INDEX)

    d = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(d, run, f"rid long, doc_id {kind.simpleString()}, n long, terms array<string>, tf array<long>, n_docs long, n_words long")


_INDEX = ["rid", "doc_id", "n", "terms", "tf", "n_docs", "n_words"]


def _impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """Fixed formula: what terms of such weights add to documents of ``n`` terms."""
    m = 100 - 90 + (90 * n * n_docs) // n_words
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Block:
    """Items of one broadcast: which terms they hold, the terms' weights and, once known, thresholds and essential terms."""

    def __init__(self, rows: list, df: dict[str, int], n_docs: int, n_words: int):
        self.items = [(r["rid"], r["item_id"]) for r in rows]
        self.terms = {t: i for i, t in enumerate(sorted({t for r in rows for t in r["terms"] if t in df}))}
        self.n_docs, self.n_words = n_docs, n_words
        self.weight = np.array([term_weight(n_docs, df[t]) for t in self.terms], dtype=np.int64)
        self.held = [np.array([self.terms[t] for t in r["terms"] if t in self.terms], dtype=np.int64) for r in rows]
        self.threshold = np.zeros(len(rows), dtype=np.int64)
        self.rest = np.zeros(len(rows), dtype=np.int64)
        self.essential = self.other = None

    def prune(self, most: np.ndarray, threshold: np.ndarray) -> None:
        """Essential terms of each item, and what the others can add at most, from the terms' largest impacts and the items' thresholds."""
        first, second = [], []
        for i, held in enumerate(self.held):
            order = held[np.argsort(most[held], kind="stable")]
            suffix = np.cumsum(most[order])
            cut = int(np.searchsorted(suffix, threshold[i]))  # the terms before it reach less than the threshold together
            self.rest[i] = suffix[cut - 1] if cut else 0
            first += [(t, i) for t in order[cut:].tolist()]
            second += [(t, i) for t in order[:cut].tolist()]
        self.threshold, self.essential, self.other = threshold, _by_term(first, len(self.terms)), _by_term(second, len(self.terms))

    def postings(self, b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the batch, term, impact) of the block's terms in a batch of the index."""
        sizes = b.column("terms").value_lengths().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(b.num_rows), sizes)
        term = np.fromiter((self.terms.get(t, -1) for t in b.column("terms").flatten().to_pylist()), dtype=np.int64, count=int(sizes.sum()))
        tf = b.column("tf").flatten().to_numpy()
        at = np.flatnonzero(term >= 0)
        row, term, tf = row[at], term[at], tf[at]
        return row, term, _impacts(self.weight[term], tf, b.column("n").to_numpy()[row], self.n_docs, self.n_words)


def _by_term(pairs: list[tuple[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each term's items start, items) of (term, item) pairs."""
    p = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
    return np.searchsorted(p[:, 0], np.arange(n + 1)), p[:, 1]


def _meet(by_term, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``term``, item) of every posting and item that hold a term in common."""
    start, item = by_term
    n = start[term + 1] - start[term]
    at = np.repeat(np.arange(len(term)), n)
    within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return at, item[start[term][at] + within]


def _largest(order: tuple, group: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group, in the order of ``np.lexsort(order + group)``."""
    by = np.lexsort((*order, group))
    g = group[by]
    first = np.flatnonzero(np.diff(g, prepend=g[0] - 1)) if len(g) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(first, append=len(g)))
    return by[rank < k]


def _heads(index: DataFrame, block, k: int) -> DataFrame:
    """The ``k`` largest impacts of each term of the block: term, impact, rid."""
    import pyarrow as pa

    def run(batches):
        best = [np.zeros(0, dtype=np.int64)] * 3
        for b in batches:
            row, term, impact = block.value.postings(b)
            rid = b.column("rid").to_numpy()[row]
            new = [np.concatenate(x) for x in zip(best, (term, impact, rid))]
            at = _largest((new[2], -new[1]), new[0], k)
            best = [x[at] for x in new]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["term", "impact", "rid"])

    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "rid"))
    return map_arrow(index, run, "term long, impact long, rid long").withColumn("rank", rank).filter(F.col("rank") <= k)


def _best(index: DataFrame, block, k: int) -> DataFrame:
    """Candidates of the block that may be among an item's ``k`` best: item, rid, doc_id, score."""
    import pyarrow as pa

    kind = index.schema["doc_id"].dataType.simpleString()

    def run(batches):
        x: Block = block.value
        threshold, n_items = x.threshold.copy(), len(x.items)
        best = None
        for whole in batches:
            step = max(1, CELLS // n_items)
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                row, term, impact = x.postings(b)
                at, item = _meet(x.essential, term)
                score = np.zeros(b.num_rows * n_items, dtype=np.int64)
                np.add.at(score, row[at] * n_items + item, impact[at])
                cell = np.flatnonzero(score)
                cell = cell[score[cell] + x.rest[cell % n_items] >= threshold[cell % n_items]]
                if not len(cell):
                    continue
                some = np.zeros(b.num_rows, dtype=bool)
                some[cell // n_items] = True
                near = some[row]
                at, item = _meet(x.other, term[near])
                np.add.at(score, row[near][at] * n_items + item, impact[near][at])
                cell = cell[score[cell] >= threshold[cell % n_items]]
                found = pa.RecordBatch.from_arrays([pa.array(cell % n_items, pa.int32()), b.column("rid").take(pa.array(cell // n_items)), b.column("doc_id").take(pa.array(cell // n_items)), pa.array(score[cell])], names=["item", "rid", "doc_id", "score"])
                best = pa.concat_batches([best, found]) if best is not None else found
                if best.num_rows > 4 * k * n_items:
                    best = _keep(best, k, threshold)
        if best is not None:
            yield _keep(best, k, threshold)

    return map_arrow(index, run, f"item int, rid long, doc_id {kind}, score long")


def _keep(found, k: int, threshold: np.ndarray):
    """The rows of each item's ``k`` best; raises thresholds to the kth score where there are so many."""
    import pyarrow as pa
    import pyarrow.compute as pc

    order = pc.sort_indices(found, [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending"), ("rid", "ascending")], null_placement="at_start")
    found = found.take(order)
    item = found.column("item").to_numpy()
    first = np.flatnonzero(np.diff(item, prepend=-1))
    rank = np.arange(len(item)) - np.repeat(first, np.diff(first, append=len(item)))
    last = rank == k - 1
    threshold[item[last]] = np.maximum(threshold[item[last]], found.column("score").to_numpy()[last])
    return found.take(pa.array(np.flatnonzero(rank < k)))


@contextmanager
def _sent(index: DataFrame, block: Block):
    """The block as a broadcast, for as long as the jobs inside run."""
    out = index.sparkSession.sparkContext.broadcast(block)
    try:
        yield out
    finally:
        out.destroy()


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "rid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _seed(index: DataFrame, block: Block, k: int) -> None:
    """Set the block's thresholds and essential terms: by its terms' kth impacts, then by the exact scores of their stored documents."""
    with _sent(index, block) as sent:
        stored = materialize(_heads(index, sent, k), "heads")
    kth, most = np.zeros(len(block.terms), dtype=np.int64), np.zeros(len(block.terms), dtype=np.int64)
    for r in stored.groupBy("term").agg(F.max("impact").alias("most"), F.max(F.when(F.col("rank") == k, F.col("impact"))).alias("kth")).collect():
        most[r["term"]], kth[r["term"]] = r["most"], r["kth"] or 0
    threshold = np.array([max([0, *kth[held].tolist()]) for held in block.held], dtype=np.int64)
    block.prune(most, threshold)
    seeds = F.broadcast(stored.select("rid").distinct())  # at most k documents for each term of the block
    with _sent(index, block) as sent:
        for r in _ranked(_best(index.join(seeds, "rid", "left_semi"), sent, k), k).filter(F.col("rank") == k).select("item", "score").collect():
            threshold[r["item"]] = max(threshold[r["item"]], r["score"])
    block.prune(most, threshold)
    discard(stored)


def _blocks(items: DataFrame, block_terms: int):
    """Rows of the items in blocks of at most so many terms, an item at least; the driver holds one block."""
    rows, held = [], 0
    for r in items.toLocalIterator():
        if rows and held + len(r["terms"]) > block_terms:
            yield rows
            rows, held = [], 0
        rows.append(r)
        held += len(r["terms"])
    if rows:
        yield rows


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    items = materialize(item_terms(items, item_key, text), "items")
    kind = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema[doc_key].dataType.simpleString()}, score long"
    if items.isEmpty():
        return spark.createDataFrame([], kind)
    index = materialize(index_documents(docs, term_filter(items), doc_key, text), "index")
    n_docs, n_words = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_words")).first())
    index = index.filter("rid IS NOT NULL")
    parts = []
    for rows in _blocks(items, block_terms):
        wanted = spark.createDataFrame([(t,) for t in sorted({t for r in rows for t in r["terms"]})], "term string")
        count = index.select(F.explode("terms").alias("term")).groupBy("term").count()
        df = {r["term"]: r["count"] for r in count.join(F.broadcast(wanted), "term", "left_semi").collect()}
        if not df:
            continue
        block = Block(rows, df, n_docs, n_words)
        _seed(index, block, k)
        names = spark.createDataFrame([(i, item_id) for i, (_, item_id) in enumerate(block.items)], f"item int, {kind.split(',')[0]}")
        with _sent(index, block) as sent:
            ranked = _ranked(_best(index, sent, k), k).join(F.broadcast(names), "item")
            parts.append(materialize(ranked.select("item_id", "rank", "doc_id", "score"), "ranked"))
    if not parts:
        return spark.createDataFrame([], kind)
    return spark.read.schema(parts[0].schema).parquet(*(p.stored_at for p in parts))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the ten best documents of every benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT row_number() OVER () AS iid, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark
), it AS (SELECT DISTINCT iid, item_id, unnest(w) AS term FROM i),
s AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT rid, doc_id, len(w)::BIGINT AS n, term, count(*) AS tf FROM (SELECT rid, doc_id, w, unnest(w) AS term FROM d) GROUP BY rid, doc_id, len(w), term),
t AS (SELECT term, floor(1000 * ln((2 * any_value(s.n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY term),
r AS (
  SELECT iid, item_id, rid, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * p.n * s.n) // s.l)))))::BIGINT AS score
  FROM it JOIN p USING (term) JOIN t USING (term), s GROUP BY iid, item_id, rid, doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS FIRST, rid) AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""
