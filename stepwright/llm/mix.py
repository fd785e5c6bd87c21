"""Mix sources to target weights, with built-in column functions only.

Words of a source, in a fixed document order, are packed into blocks of
``block_words``. A source with ``n`` blocks and target ``t`` gets
``round(t / size * n)`` slots. Slots are dealt to output shards of ``shard_slots``
places: each shard's counts of sources are a multinomial draw without replacement
from these quotas, so shares are exact over all shards. Slot ``k`` reads block ``perm(k mod n)`` of pass ``k div n``, where ``perm`` is
a pseudorandom permutation of the source's block indices for that pass (a
swap-or-not network, exact for every n). Slots, blocks and documents meet in
joins on (source, block index). ``mixed_shards`` returns the shards themselves.

Targets: sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ... and
share the size of all sources; a target stops at ``max_repeats`` times its
source's size and the excess goes to the others by weight (water filling, in
closed form over sources sorted by size per weight).

Documents of a source are ordered by a mixed bucket of doc_id, then doc_id and
size. Their offsets are sums in two levels (within a bucket, over buckets), so
no task orders a whole source.

Defined cases: null text has size 0 and is taken 0 times; null doc_id is ordered
as -1; null source is a source of its own, last. Repeated rows are documents of
their own. Columns beside doc_id, source and the text are not read. No rows in,
no rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import TASK_TEXTS, WORD_SQL, few_tasks, materialize, text_or_empty

BLOCK_WORDS = 64
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
BUCKET_DOCS = 500
SHARD_SLOTS = 4096
SLOT_CHUNK, SPAN_CHUNKS = 4096, 4096
TASK_SLOTS = 100_000
ROUNDS = 12
SEED = 20240607
#: A prime modulus below 2^31: products of two residues fit a long in any SQL engine.
P = 2147483647


def residue(x: Column, p: int = P) -> Column:
    return ((x.cast("long") % p) + p) % p


def stir(x: Column) -> Column:
    """Mix a residue below P: shift, square, scale. x occurs twice in the result; keep it small."""
    y = (x.cast("long") + 1013904223) % P
    return (y * y % P) * 48271 % P


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with ``size``, the number of words of the whole text."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(text_or_empty(text), F.lit(WORD_SQL)), F.lit(0)).cast("long"))


def source_targets(rows: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, rank, source_size, weight, target for rows of (source, size)."""
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("rank", F.row_number().over(by_code).cast("long"))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    cap = F.col("source_size") * max_repeats
    everything = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    s = s.withColumn("cap", cap).withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(1))))
    # Capped sources are a prefix of this order: level = what is left for the rest, by their weight.
    s = s.withColumn("capped_before", F.coalesce(F.sum("cap").over(everything.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("weight_from", F.sum("weight").over(Window.partitionBy(F.lit(1))) - F.coalesce(F.sum("weight").over(everything.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_from"))
    free = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.first(F.when(free, F.col("level")), ignorenulls=True).over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(level.isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), level * F.col("weight")))
    return s.select("source", "rank", "source_size", "source_rows", "weight", target.alias("target"))


def with_offsets(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Rows of (rid, doc_id, rank, size) with ``offset``: words of the source before each document."""
    key = residue(F.coalesce(F.col("doc_id"), F.lit(-1)))
    d = rows.withColumn("bucket", stir(key) % n_buckets)
    sums = d.groupBy("rank", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_before"))
    inside = Window.partitionBy("rank", "bucket").orderBy(F.coalesce(F.col("doc_id"), F.lit(-1)), "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return d.join(sums, ["rank", "bucket"]).withColumn("offset", F.col("within") + F.col("bucket_before")).drop("bucket", "within", "bucket_before")


def round_keys(rank: Column, number: Column, n: Column, seed: int, rounds: int = ROUNDS) -> tuple[Column, Column]:
    """For one pass over a source's blocks: its key, and (from the column base_key) an array of (turn, a, k) by round."""
    base = stir(stir(residue(F.lit(seed) + rank * 104729 + number * 15485863)))

    def keys(r: Column) -> Column:
        part = [stir(stir((F.col("base_key") + r * 7919 + i) % P)) for i in range(4)]
        return F.struct(((part[0] * P + part[1]) % n).alias("turn"), (part[2] + 1).alias("a"), part[3].alias("k"))

    return base, F.transform(F.sequence(F.lit(1).cast("long"), F.lit(rounds).cast("long")), keys)


def permuted(index: Column, n: Column, keys: Column) -> Column:
    """Swap-or-not: in each round the index and its mirror about the round's turn swap or not."""

    def step(x: Column, r: Column) -> Column:
        mirror = (r["turn"] - x + n) % n
        return F.when(((F.greatest(x, mirror) % P) * r["a"] + r["k"]) % P % 2 == 1, mirror).otherwise(x)

    return F.aggregate(keys, index, step)


def draw_slots(sources: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, max_repeats: int = MAX_REPEATS, tasks: int | None = None) -> DataFrame:
    """One row per slot of the mix: rank, slot, shard, place, block.

    All slots of all sources stand in one row, source after source; a
    pseudorandom permutation of that row deals them to the places of the output
    shards. So a shard's counts of sources are a multinomial draw, under the
    condition that all shards together use each source's quota: shards are of one
    length (the last may be shorter) and no source misses its target.

    Slots are generated in spans and chunks that are dealt out before they are
    expanded, so a source with a third of all words is not expanded in one task.
    Give ``tasks``, as chunk rows are so small that they would be put in one.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    s = sources.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long")).filter("blocks > 0")
    s = s.withColumn("slots", F.least(F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("long"), F.col("blocks") * max_repeats)).filter("slots > 0")
    s = s.withColumn("all_slots", F.sum("slots").over(Window.partitionBy(F.lit(1))))
    s = s.withColumn("slots_before", F.sum("slots").over(Window.orderBy("rank")) - F.col("slots"))
    s = s.withColumn("pass", F.explode(F.sequence(zero, F.floor((F.col("slots") - 1) / F.col("blocks")).cast("long"))))
    s = s.withColumn("here", F.least(F.col("blocks"), F.col("slots") - F.col("pass") * F.col("blocks")))
    span = F.explode(F.sequence(zero, F.floor((F.col("here") - 1) / (SLOT_CHUNK * SPAN_CHUNKS)).cast("long")))
    spans = s.select("rank", "blocks", "all_slots", "slots_before", "pass", "here", span.alias("span")).repartition("rank", "pass", "span")
    last = F.least((F.col("span") + 1) * SPAN_CHUNKS - 1, F.floor((F.col("here") - 1) / SLOT_CHUNK).cast("long"))
    chunks = spans.withColumn("chunk", F.explode(F.sequence(F.col("span") * SPAN_CHUNKS, last)))
    chunks = chunks.repartition(tasks, "rank", "pass", "chunk") if tasks else chunks.repartition("rank", "pass", "chunk")
    base, keys = round_keys(F.col("rank"), F.col("pass"), F.col("blocks"), seed)
    chunks = chunks.withColumn("base_key", base).withColumn("keys", keys)
    base, keys = round_keys(zero, zero, F.col("all_slots"), seed)
    chunks = chunks.withColumn("base_key", base).withColumn("place_keys", keys)
    first = F.col("chunk") * SLOT_CHUNK
    k = chunks.withColumn("index", F.explode(F.sequence(first, F.least(first + SLOT_CHUNK, F.col("here")) - one)))
    k = k.withColumn("slot", F.col("pass") * F.col("blocks") + F.col("index")).withColumn("block", permuted(F.col("index"), F.col("blocks"), F.col("keys")))
    k = k.withColumn("dealt", permuted(F.col("slots_before") + F.col("slot"), F.col("all_slots"), F.col("place_keys")))
    return k.select("rank", "slot", F.floor(F.col("dealt") / shard_slots).cast("long").alias("shard"), (F.col("dealt") % shard_slots).alias("place"), "block")


def mix_rows(rows: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For a stored table of (rid, doc_id, source, size): (documents, cuts, slots).

    documents: rid, doc_id, size, source_size, target. cuts: rank, block, rid,
    start (the word of the document), words; a row per block that a document
    shares. slots: as ``draw_slots``. Cuts and slots meet on (rank, block).
    """
    sources = materialize(source_targets(rows), "mix-sources", 1)
    n_docs, n_words = sources.agg(F.coalesce(F.sum("source_rows"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    tasks = max(1, -(-n_words // (block_words * TASK_SLOTS)))
    d = rows.join(sources.select("source", "rank", "source_size", "target"), rows["source"].eqNullSafe(sources["source"]), "inner").drop(sources["source"])
    slots = draw_slots(sources, seed, block_words, shard_slots, tasks=tasks)
    placed = with_offsets(d.filter("size > 0").select("rid", "doc_id", "rank", "size"), max(1, -(-n_docs // BUCKET_DOCS)))
    last = F.floor((F.col("offset") + F.col("size") - 1) / block_words).cast("long")
    cut = placed.select("rid", "rank", "offset", "size", F.explode(F.sequence(F.floor(F.col("offset") / block_words).cast("long"), last)).alias("block"))
    begin = F.greatest(F.col("offset"), F.col("block") * block_words)
    end = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block_words)
    cuts = cut.select("rank", "block", "rid", (begin - F.col("offset")).alias("start"), (end - begin).alias("words"), F.greatest(F.lit(0), F.col("offset") - F.col("block") * block_words).alias("at"))
    return d.select("rid", "doc_id", "size", "source_size", "target"), cuts, slots


def pieces(cuts: DataFrame, slots: DataFrame) -> DataFrame:
    """rid, start, words, times, first_shard, last_shard: a row per cut whose block is taken, with how often and where.

    Slots of a block, ``max_repeats`` at most, are counted before they meet the cuts.
    """
    taken = slots.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    # Rows made by explode escape Catalyst's size estimate: without the hint it would broadcast the counts of all blocks.
    return cuts.join(taken.hint("merge"), ["rank", "block"]).select("rid", "start", "words", "times", "first_shard", "last_shard")


def taken_words(rows: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """rid, doc_id, size, source_size, target, taken, first_shard, last_shard for a stored table of (rid, doc_id, source, size)."""
    documents, cuts, slots = mix_rows(rows, seed, block_words)
    sums = pieces(cuts, slots).groupBy("rid").agg(F.sum(F.col("words") * F.col("times")).alias("taken"), F.min("first_shard").alias("first_shard"), F.max("last_shard").alias("last_shard"))
    out = documents.join(sums, "rid", "left").withColumn("taken", F.coalesce(F.col("taken"), F.lit(0)).cast("long"))
    return out.coalesce(few_tasks(rows.sparkSession, rows.count()))


def _numbered(docs: DataFrame, text: str) -> DataFrame:
    """The stored rows (row, rid) with doc_id, source and size beside them."""
    names = docs.columns
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col(text).alias("text"))
    return materialize(sized(base).drop("text").withColumn("rid", F.monotonically_increasing_id()), "mix-input", few_tasks(docs.sparkSession, docs.count(), TASK_TEXTS))


def mixed_shards(docs: DataFrame, text: str = "text", seed: int = SEED, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix itself: shard, place, source, doc_ids, text; a row per slot, whose text is the words of its block.

    Places of a shard count from 0; a source's last block may be shorter. Documents
    of a block stand in their order, and doc_ids names them.
    """
    stored = _numbered(docs, text)
    _, cuts, slots = mix_rows(stored.select("rid", "doc_id", "source", "size"), seed, block_words, shard_slots)
    words = F.regexp_extract_all(text_or_empty(), F.lit(WORD_SQL), F.lit(0))
    plan = cuts.join(slots.select("rank", "block").distinct().hint("merge"), ["rank", "block"]).groupBy("rid").agg(F.collect_list(F.struct("rank", "block", "at", "start", "words")).alias("plan"))
    j = stored.select("rid", "doc_id", "source", F.col("row").getField(text).alias("text")).join(plan, "rid")
    cut = j.select("doc_id", "source", words.alias("all_words"), F.explode("plan").alias("p")).select("doc_id", "source", "p.rank", "p.block", "p.at", F.array_join(F.slice("all_words", (F.col("p.start") + 1).cast("int"), F.col("p.words").cast("int")), " ").alias("words"))
    block = cut.groupBy("rank", "block").agg(F.first("source").alias("source"), F.array_sort(F.collect_list(F.struct("at", "doc_id", "words"))).alias("parts"))
    out = slots.join(block.hint("merge"), ["rank", "block"])
    return out.select("shard", "place", "source", F.col("parts.doc_id").alias("doc_ids"), F.array_join(F.col("parts.words"), " ").alias("text"))


def mixed_documents(docs: DataFrame, text: str = "text", seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents with the columns of ``docs``.

    Copy r of a document (r = 1 to 3) holds the words whose block is taken at
    least r times, in order; copies without words are left out. A copy that
    takes every word keeps the text as it is, others join their words by one
    space. ``n_chars`` is counted anew where it is a column.
    """
    names = docs.columns
    stored = _numbered(docs, text)
    _, cuts, slots = mix_rows(stored.select("rid", "doc_id", "source", "size"), seed, block_words)
    plan = pieces(cuts, slots).groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "words", "times"))).alias("plan"))
    j = stored.select("rid", "row", F.col("row").getField(text).alias("text"), "size").join(plan, "rid").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max("plan.times"))))
    mine = F.filter("plan", lambda x: x["times"] >= F.col("copy"))
    got = F.aggregate(mine, F.lit(0).cast("long"), lambda a, x: a + x["words"])
    words = F.regexp_extract_all(text_or_empty(), F.lit(WORD_SQL), F.lit(0))
    cut = F.array_join(F.flatten(F.transform(mine, lambda x: F.slice(F.col("all_words"), (x["start"] + 1).cast("int"), x["words"].cast("int")))), " ")
    j = j.withColumn("all_words", F.when(got < F.col("size"), words)).withColumn("text", F.when(got < F.col("size"), cut).otherwise(F.col("text")))
    new = {text: F.col("text")}
    if "n_chars" in names:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    j = j.coalesce(few_tasks(docs.sparkSession, stored.count(), TASK_TEXTS))
    return j.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the mix of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = sized(docs).select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "size")
    return taken_words(materialize(narrow, "mix-sizes")).select("doc_id", "size", "source_size", "target", "taken", "first_shard", "last_shard")


def _stir_sql(x: str) -> str:
    y = f"(({x} + 1013904223) % {P})"
    return f"(({y} * {y} % {P}) * 48271 % {P})"


def _round_sql(t: str, r: int, n: str = "blocks") -> str:
    """One swap-or-not round: x becomes x or its mirror."""
    part = [_stir_sql(_stir_sql(f"((base_key + {r * 7919 + i}) % {P})")) for i in range(4)]
    return f"""{t}{r} AS (SELECT * EXCLUDE (x, turn, a, k),
    CASE WHEN ((greatest(x, (turn - x + {n}) % {n}) % {P}) * a + k) % {P} % 2 = 1 THEN (turn - x + {n}) % {n} ELSE x END AS x
  FROM (SELECT *, ({part[0]} * {P} + {part[1]}) % {n} AS turn, {part[2]} + 1 AS a, {part[3]} AS k FROM {t}{r - 1}))"""


ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM d GROUP BY source
), s1 AS (
  SELECT *, [1, 2, 3][((rank - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * {MAX_REPEATS} AS cap FROM s0
), s2 AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce((sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))::DOUBLE
    / ((sum(weight) OVER ())::BIGINT - coalesce((sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))::DOUBLE AS level FROM s1
), s3 AS (
  SELECT *, (SELECT arg_min(level, (cap::DOUBLE / weight, rank)) FROM s2 WHERE level * weight <= cap) AS lambda_ FROM s2
), s AS (
  SELECT source, rank, source_size, CASE WHEN lambda_ IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, lambda_ * weight) END AS target,
         ceil(source_size::DOUBLE / {BLOCK_WORDS})::BIGINT AS blocks FROM s3
), q AS (
  SELECT *, least(round(target / source_size * blocks)::BIGINT, blocks * {MAX_REPEATS}) AS slots FROM s WHERE blocks > 0
), q2 AS (
  SELECT *, (sum(slots) OVER ())::BIGINT AS all_slots, (sum(slots) OVER (ORDER BY rank) - slots)::BIGINT AS slots_before FROM q WHERE slots > 0
), r0 AS (
  SELECT rank, blocks, all_slots, slots_before + slot AS nth, slot % blocks AS x, {_stir_sql(_stir_sql(f"(({SEED} + rank * 104729 + (slot // blocks) * 15485863) % {P})"))} AS base_key
  FROM (SELECT *, unnest(range(slots)) AS slot FROM q2)
), {", ".join(_round_sql("r", r) for r in range(1, ROUNDS + 1))}, p0 AS (
  SELECT rank, all_slots, x AS block, nth AS x, {_stir_sql(_stir_sql(f"({SEED}::BIGINT % {P})"))} AS base_key FROM r{ROUNDS}
), {", ".join(_round_sql("p", r, "all_slots") for r in range(1, ROUNDS + 1))}, taken AS (
  SELECT rank, block, count(*) AS times, min(x // {SHARD_SLOTS}) AS first_shard, max(x // {SHARD_SLOTS}) AS last_shard FROM p{ROUNDS} GROUP BY ALL
), o AS (
  SELECT rid, rank, size, coalesce((sum(size) OVER (PARTITION BY rank ORDER BY bucket, coalesce(doc_id, -1), size, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS offset_
  FROM (SELECT d.*, s.rank, {_stir_sql(f"(((coalesce(doc_id, -1) % {P}) + {P}) % {P})")} % greatest(1, (SELECT (count(*) + {BUCKET_DOCS - 1}) // {BUCKET_DOCS} FROM d)) AS bucket
        FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source) WHERE size > 0
), c AS (
  SELECT *, unnest(range(offset_ // {BLOCK_WORDS}, (offset_ + size - 1) // {BLOCK_WORDS} + 1)) AS block FROM o
), t AS (
  SELECT rid, sum((least(offset_ + size, (c.block + 1) * {BLOCK_WORDS}) - greatest(offset_, c.block * {BLOCK_WORDS})) * times) AS taken,
         min(first_shard) AS first_shard, max(last_shard) AS last_shard
  FROM c JOIN taken USING (rank, block) GROUP BY rid
)
SELECT d.doc_id, d.size, s.source_size, s.target, coalesce(t.taken, 0)::BIGINT AS taken, t.first_shard::BIGINT AS first_shard, t.last_shard::BIGINT AS last_shard
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN t ON d.rid = t.rid
"""
