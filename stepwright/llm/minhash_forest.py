"""MinHash near-dedup with an LSH forest.

A document is its set of distinct ``k``-word shingles. Documents with equal
sets are one class, which has a number; only classes enter the forest, as
representatives. Each has ``trees`` signature prefixes of ``depth`` minhashes,
one per tree. A tree is its representatives in the order of their prefix, over
all tasks (range partitions; the representative's id breaks ties, so no region
is one task's alone). Candidates of a representative are the next ones in that
order that share at least ``min_depth`` minhashes: the longest common prefixes,
up to ``look_ahead`` rows away. A neighbour is plausible if the set sizes allow
the similarity and a 128-bit sketch does not rule it out. A pair is taken if it is
among the ``keep`` most alike plausible ones, by sketch, of either of its rows.
In a sparse region that reaches down to ``min_depth`` shared minhashes; in a
crowded one the order puts deeper prefixes first, so the depth adapts to the
region. A row is crowded if in some tree rows that share ``min_depth`` minhashes
lie beyond its look-ahead, or if a plausible pair of it was not among the taken.

Candidates are confirmed on full shingle sets in two rounds: first the nearest
neighbours of the first ``lead_trees`` trees, then those candidates that still
join two components. Links inside a component cannot change the result. Then
all crowded rows meet in an exact prefix-filter join on their shingles, rare
ones first, for pairs across components (``crowded_pairs``), again in two
rounds: the likeliest pair of each two components, then what is left.

Misses: a pair at similarity 0.8 shares two minhashes in one tree with
probability 0.64, so 20 trees all fail with 1e-9. The sketch rules out a true
pair at 0.8 with 3e-6, and fewer the more alike. What the look-ahead and the
choice of most alike pairs leave out, the exact join of crowded rows finds.

Defined cases: null or wordless texts have n_shingles 0, link with nothing and
are their own component. Rows that repeat a doc_id are one node if their sets
are equal. A null doc_id takes the component of its set; if no row of the set
has a doc_id the component is null. kept is doc_id = component_id, null-safe.
Rows that repeat a doc_id with another set are nodes of their own, and each has
the component of its set. Other columns are ignored. No rows in, no rows out.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TASK_TEXTS, discard, few_tasks, map_arrow, materialize, values_of
from .components import components
from .shingles import fold_words, shingle_set

SHINGLE = 5
PERCENT = 80
TREES = 20
DEPTH = 6
MIN_DEPTH = 2
HASHES = 128
LOOK_AHEAD = 64
KEEP = 4
LEAD_TREES = 4
#: Equal bits of 128 below which a pair is ruled out; at similarity 0.8 the mean is 115.2 and the deviation 3.4.
MIN_EQUAL_BITS = 98
#: Buckets of shingles whose counts order the shingles of crowded rows; any order gives the same pairs.
RARITY_BUCKETS = 1 << 20
#: Ranges of a tree whose borders one task looks at, and those before them that it sees too.
BORDER_RANGES, BORDER_OVERLAP = 256, 8

_rng = np.random.default_rng(20240607)
_MUL = (_rng.integers(0, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def minhashes(s: np.ndarray) -> np.ndarray:
    """128 minhashes of 32 bits of a set of 64-bit hashes."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 1024):
        least = np.minimum(least, (s[i : i + 1024, None] * _MUL + _ADD).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def _name(s: np.ndarray) -> tuple:
    """128 bits that name a set, as two signed numbers; none for the empty set."""
    if not len(s):
        return None, None
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def features(docs: DataFrame, text: str = "text", k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (128 bits that name the set) and signature (128 minhashes)."""
    import pyarrow as pa

    def compute(batches):
        for b in batches:
            n, k1, k2, sig = [], [], [], []
            for t in values_of(b.column(1)):
                s = shingle_set(fold_words(t), k)
                n.append(len(s))
                x, y = _name(s)
                k1.append(x)
                k2.append(y)
                sig.append(minhashes(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "k1", "k2", "signature"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), compute, "doc_id long, n_shingles long, k1 long, k2 long, signature binary")


def _fixed(a: np.ndarray):
    """A binary Arrow array of the rows of a byte matrix."""
    import pyarrow as pa

    n, w = a.shape
    offsets = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * w).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(a).tobytes())])


def forest_rows(reps: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """One row per representative and tree: path (tree and prefix), rep, n_shingles, sketch."""
    import pyarrow as pa

    def explode(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.uint32).reshape(part.num_rows, HASHES)
                sketch = np.packbits((sig & 1).astype(np.uint8), axis=1)
                for t in range(trees):
                    prefix = sig[:, t * depth : (t + 1) * depth].astype(">u4").view(np.uint8).reshape(part.num_rows, -1)
                    path = np.concatenate([np.full((part.num_rows, 1), t, dtype=np.uint8), prefix], axis=1)
                    yield pa.RecordBatch.from_arrays([_fixed(path), part.column(0), part.column(1), _fixed(sketch)], names=["path", "rep", "n_shingles", "sketch"])

    return map_arrow(reps.select("rep", "n_shingles", "signature"), explode, "path binary, rep long, n_shingles long, sketch binary")


def _best(of: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """The place of each entry among those of the same row, the most equal bits first."""
    order = np.lexsort((-equal, of))
    s = of[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    place = np.empty(len(of), dtype=np.int64)
    place[order] = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
    return place


def _neighbours(path, rep, size, sketch, fresh: int, min_depth: int, look_ahead: int, keep: int, lead_trees: int):
    """Candidate pairs (u, v, lead) of ordered rows whose later row is at ``fresh`` or beyond, and the crowded rows.

    Rows are in path order, so a row whose common prefix with the row d ahead is
    too short has none further on: it leaves the search, and only crowded
    regions look far.
    """
    n, head = len(rep), path[:, : 1 + 4 * min_depth]
    active, found, cut = np.arange(n), [], rep[:0]
    for d in range(1, min(look_ahead, n - 1) + 1):
        active = active[active < n - d]
        active = active[(head[active] == head[active + d]).all(axis=1)]
        if not len(active):
            break
        if d == look_ahead:
            cut = np.concatenate([rep[active], rep[active + d]])
        i = active[active + d >= fresh]
        j = i + d
        ok = (rep[i] != rep[j]) & (100 * np.minimum(size[i], size[j]) >= PERCENT * np.maximum(size[i], size[j]))
        i, j = i[ok], j[ok]
        equal = 128 - np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
        ok = equal >= MIN_EQUAL_BITS
        found.append((i[ok], j[ok], equal[ok]))
    if not found:
        return [np.zeros(0, np.int64)] * 2 + [np.zeros(0, bool), np.unique(cut)]
    i, j, equal = (np.concatenate(x) for x in zip(*found))
    place = np.minimum(_best(i, equal), _best(j, equal)) if len(i) else i
    ok = place < keep
    cut = np.unique(np.concatenate([cut, rep[i[~ok]], rep[j[~ok]]]))
    i, j, place = i[ok], j[ok], place[ok]
    return rep[i], rep[j], (place == 0) & (path[i, 0] < lead_trees), cut


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def candidate_pairs(reps: DataFrame, few: int, trees: int = TREES, depth: int = DEPTH, min_depth: int = MIN_DEPTH, look_ahead: int = LOOK_AHEAD, keep: int = KEEP, lead_trees: int = LEAD_TREES) -> tuple[DataFrame, DataFrame]:
    """Stored tables: distinct candidate pairs u < v with ``lead``, true for nearest neighbours in the leading trees; and the crowded rows (node)."""
    import pyarrow as pa

    width = 1 + 4 * depth

    def search(batches, edges: bool = True):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tail, first_rows, seen = None, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            now = [_matrix(b.column(0), width), b.column(1).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3), HASHES // 8)]
            if edges and seen < look_ahead:
                first_rows.append([x[: look_ahead - seen] for x in now])
            seen += b.num_rows
            fresh = 0
            if tail is not None:
                fresh = len(tail[1])
                now = [np.concatenate(x) for x in zip(tail, now)]
            u, v, lead, cut = _neighbours(*now, fresh, min_depth, look_ahead, keep, lead_trees)
            tail = [x[-look_ahead:] for x in now]
            if len(cut):
                m = len(cut)
                yield pa.RecordBatch.from_arrays([pa.array(cut), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64())], names=names)
            if len(u):
                none = pa.nulls(len(u), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(lead), pa.nulls(len(u), pa.int64()), none, none, pa.nulls(len(u), pa.int64())], names=names)
        if edges and seen:
            first = [np.concatenate(x) for x in zip(*first_rows)]
            both = [np.concatenate([a, t[max(0, len(t) - max(0, seen - len(a))) :]]) for a, t in zip(first, tail)]
            n = len(both[1])
            yield pa.RecordBatch.from_arrays([pa.array(both[1]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(np.full(n, part)), _fixed(both[0]), _fixed(both[3]), pa.array(both[2])], names=names)

    names = ["u", "v", "lead", "part", "path", "sketch", "n_shingles"]
    schema = "u long, v long, lead boolean, part long, path binary, sketch binary, n_shingles long"
    rows = forest_rows(reps, trees, depth).repartitionByRange("path", "rep").sortWithinPartitions("path", "rep")
    found = materialize(map_arrow(rows, search, schema), "forest")
    # The first and last rows of each range meet once more, in order: neighbours across a border. A task takes
    # BORDER_RANGES ranges and the few before them, so that its first row too has the neighbours it had.
    group = F.floor(F.col("part") / BORDER_RANGES)
    last = F.pmod(F.col("part"), F.lit(BORDER_RANGES)) >= BORDER_RANGES - BORDER_OVERLAP
    borders = found.filter("part is not null").withColumn("group", F.explode(F.when(last, F.array(group, group + 1)).otherwise(F.array(group))))
    borders = borders.select("group", "path", F.col("u").alias("rep"), "n_shingles", "sketch").repartition("group").sortWithinPartitions("group", "path", "rep").drop("group")
    across = map_arrow(borders, lambda batches: search(batches, False), schema)
    every = found.filter("part is null").select("u", "v", "lead").unionByName(across.select("u", "v", "lead"))
    pairs = every.filter("v is not null").groupBy("u", "v").agg(F.max("lead").alias("lead"))
    pairs, crowded = materialize(pairs, "pairs", few), materialize(every.filter("v is null").select(F.col("u").alias("node")).distinct(), "crowded", few)
    discard(found)
    return pairs, crowded


def _rarity(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets fall into each bucket; a table of fixed size."""
    import pyarrow as pa

    def count(batches):
        total = np.zeros(RARITY_BUCKETS, dtype=np.int64)
        for b in batches:
            total += np.bincount(_bucket(_flat(b.column(0))), minlength=RARITY_BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"k": pa.array(at), "n": pa.array(total[at])})

    found = map_arrow(sets.select("set"), count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(RARITY_BUCKETS, dtype=np.int64)
    out[found.column("k").to_numpy()] = found.column("n").to_numpy()
    return out


def _flat(sets) -> np.ndarray:
    """The shingles of an Arrow array of sets, set after set."""
    return sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s % np.uint64(RARITY_BUCKETS)).astype(np.int64)


def shingle_sets(docs: DataFrame, wanted: DataFrame, text: str, k: int) -> DataFrame:
    """(node, set) for ``wanted`` rows of (node, rep, k1, k2): the shingles of the rows of doc_id ``rep`` whose set has that name.

    A doc_id may repeat with other texts: its rows are told apart by the name of their set.
    """
    import pyarrow as pa

    def compute(batches):
        for b in batches:
            nodes, sets = [], []
            for node, k1, k2, t in zip(*map(values_of, b.columns)):
                s = shingle_set(fold_words(t), k)
                if _name(s) == (k1, k2):
                    nodes.append(node)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    plain = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col(text).alias("text")).filter("rep is not null and text is not null")
    found = plain.join(wanted.hint("merge"), "rep")
    return map_arrow(found.groupBy("rep", "node", "k1", "k2", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).select("node", "k1", "k2", "text"), compute, "node long, set array<long>")


def crowded_pairs(sets: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Every pair that can reach the similarity among rows of (node, component, set) of different components.

    u < v, both components and ``shared``, how many prefix shingles the pair has
    in common; and the stored table of prefixes behind it.

    The shingles of a row are in one order for all rows, rare ones first. The
    first common one of a pair lies in the prefix of both: its places bound what
    the pair can have in common. The row with fewer shingles has the shorter
    prefix. Rows meet by (shingle, two components), so a large component is not
    joined with itself, and no list of rows is cut.
    """
    import pyarrow as pa

    shared = sets.sparkSession.sparkContext.broadcast(_rarity(sets))

    def prefixes(batches):
        names = ["g", "node", "component", "n", "place"]
        for b in batches:
            flat, ends = _flat(b.column(2)), np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False))
            for node, component, end, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ends.tolist(), np.diff(ends, prepend=0).tolist()):
                s = flat[end - n : end]
                often = shared.value[_bucket(s)]
                order = np.lexsort((s, often))[: n - -(-percent * n // 100) + 1]
                place = np.flatnonzero(often[order] > 1)
                if len(place):
                    m = len(place)
                    yield pa.RecordBatch.from_arrays([pa.array(s[order[place]].view(np.int64)), pa.array(np.full(m, node)), pa.array(np.full(m, component)), pa.array(np.full(m, n)), pa.array(place + 1)], names=names)

    rows = materialize(map_arrow(sets.select("node", "component", "set"), prefixes, "g long, node long, component long, n long, place long"), "prefixes")
    shared.destroy()
    short = rows.filter(F.lit(100 + percent) * (F.col("n") - F.col("place") + 1) >= 2 * percent * F.col("n"))
    # What a row can have in common with a row of m shingles is enough if its room is at least percent * m.
    room = (100 + percent) * (F.col("n") - F.col("place") + 1) - percent * F.col("n")

    def by_component(of: DataFrame, c: str) -> DataFrame:
        """The components of a shingle with the bounds of their rows; a component of one row is bounded by the row itself."""
        return of.groupBy("g", F.col("component").alias("c" + c)).agg(F.min("n").alias("least_" + c), F.max("n").alias("most_" + c), F.max(room).alias("room_" + c))

    def meet(least_x, most_x, room_x, least_y, most_y, room_y):
        return (least_x <= most_y) & (100 * most_x >= percent * least_y) & (room_x >= percent * least_y) & (room_y >= percent * least_x)

    cx, cy = ([F.col(n + c) for n in ("least_", "most_", "room_")] for c in "xy")
    cross = by_component(short, "x").join(by_component(rows, "y").hint("merge"), "g").filter(F.col("cx") != F.col("cy")).filter(meet(*cx, *cy)).select("g", "cx", "cy", *cy)
    x = short.select("g", F.col("component").alias("cx"), F.col("node").alias("x"), F.col("n").alias("nx"), room.alias("rx"))
    y = rows.select("g", F.col("component").alias("cy"), F.col("node").alias("y"), F.col("n").alias("ny"), room.alias("ry"))
    nx, ny, rx, ry = (F.col(c) for c in ("nx", "ny", "rx", "ry"))
    j = cross.join(x.hint("merge"), ["g", "cx"]).filter(meet(nx, nx, rx, *cy)).drop("least_y", "most_y", "room_y")
    j = j.join(y.hint("merge"), ["g", "cy"]).filter(meet(nx, nx, rx, ny, ny, ry)).filter((nx < ny) | (F.col("x") < F.col("y")))
    first = F.col("x") < F.col("y")
    j = j.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), F.when(first, F.col("cx")).otherwise(F.col("cy")).alias("cu"), F.when(first, F.col("cy")).otherwise(F.col("cx")).alias("cv"))
    return j.groupBy("u", "v", "cu", "cv").agg(F.count(F.lit(1)).alias("shared")), rows


def _still_apart(pairs: DataFrame, so_far: DataFrame) -> DataFrame:
    """The pairs (u, v) that join two components."""
    j = pairs.select("u", "v").join(so_far.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left").join(so_far.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
    return j.filter(F.coalesce("cu", "u") != F.coalesce("cv", "v"))


def _stars(so_far: DataFrame) -> DataFrame:
    return so_far.select(F.col("component").alias("u"), F.col("node").alias("v"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (u, v) whose full shingle sets reach the similarity; ``sets`` has node and set."""
    left, right = sets.select(F.col("node").alias("u"), F.col("set").alias("set_u")), sets.select(F.col("node").alias("v"), F.col("set").alias("set_v"))
    both = F.size(F.array_intersect("set_u", "set_v"))
    alike = 100 * both >= percent * (F.size("set_u") + F.size("set_v") - both)
    return pairs.select("u", "v").join(left, "u").join(right, "v").filter(alike).select("u", "v")


def near_duplicates(docs: DataFrame, text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Distinct sets are numbered, and candidates, links and components are made of
    these numbers; a component then takes the smallest doc_id of its sets.
    """
    feats = materialize(features(docs, text, k), "minhash")
    few = few_tasks(docs.sparkSession, feats.count())
    classes = feats.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = materialize(classes.filter("rep is not null").withColumn("node", F.monotonically_increasing_id()), "classes", few)
    pairs, crowded = candidate_pairs(classes.withColumnRenamed("rep", "doc_id").withColumnRenamed("node", "rep"), few)
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).unionByName(crowded).distinct()
    wanted = classes.select("node", "rep", "k1", "k2").join(nodes.hint("merge"), "node", "left_semi")
    sets = materialize(shingle_sets(docs, wanted, text, k), "candidate-sets", 2 * few)
    first = materialize(confirm(pairs.filter("lead"), sets, percent), "links", 2 * few)
    so_far = components(first)
    second = materialize(confirm(_still_apart(pairs.filter("not lead"), so_far), sets, percent), "links", 2 * few)
    final = components(_stars(so_far).unionByName(second))
    scratch = [first, second]
    if not crowded.isEmpty():
        members = crowded.join(final, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        found, prefixes = crowded_pairs(sets.join(members.hint("merge"), "node"), percent)
        rest = materialize(found, "crowded-pairs", few)
        likely = rest.groupBy(F.least("cu", "cv"), F.greatest("cu", "cv")).agg(F.max(F.struct("shared", "u", "v")).alias("p")).select("p.u", "p.v")
        third = materialize(confirm(likely, sets, percent), "links", 2 * few)
        so_far = components(_stars(final).unionByName(third))
        fourth = materialize(confirm(_still_apart(rest, so_far), sets, percent), "links", 2 * few)
        final = components(_stars(so_far).unionByName(fourth))
        scratch += [prefixes, rest, third, fourth]
    discard(pairs, crowded, sets, *scratch)
    placed = classes.select("k1", "k2", "rep", "node").join(final, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = placed.select("k1", "k2", "root").join(least.hint("merge"), "root").drop("root")
    j = feats.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return j.select("doc_id", "n_shingles", component.alias("component_id")).coalesce(few).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """One document of each group of near-duplicates, with all its columns: the one with the smallest doc_id.

    Rows are numbered once, and groups are made of row numbers: a null or repeated
    doc_id joins nothing. A group without any doc_id keeps its first row.
    """
    spark, names = docs.sparkSession, docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.monotonically_increasing_id().alias("rid"))
    stored = materialize(row, "dedup-input", few_tasks(spark, docs.count(), TASK_TEXTS))
    found = near_duplicates(stored.select(F.col("rid").alias("doc_id"), F.col("row").getField(text).alias("text")))
    ids = stored.select("rid", F.col("row").getField("doc_id").cast("long").alias("id"))
    named = found.select(F.col("doc_id").alias("rid"), "component_id").join(ids.hint("merge"), "rid")
    chosen = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "rid")).alias("first")).select("first.rid")
    out = stored.join(chosen.hint("merge"), "rid", "left_semi")
    return out.select(*[F.col("row").getField(c).alias(c) for c in names]).coalesce(few_tasks(spark, stored.count(), TASK_TEXTS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: near-duplicates among all documents, on 4-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + least(4, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS p FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM both_ JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
sym AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT sym.v, r.root FROM r JOIN sym ON sym.u = r.doc_id WHERE r.root < sym.v),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.root, d.doc_id)::BIGINT AS component_id, coalesce(c.root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
