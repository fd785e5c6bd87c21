"""Quality by co-training of a text view and a metadata view.

View 1 (content) sees which words a document has: hashed lower-case words,
``CONTENT`` numbers. View 2 (page metadata) sees what can be known without reading
them: source, language, length, the layout of the page (lines, their lengths and
repetition, shares of capitals, digits and signs) and how often each word shape
(such as a capital before small letters before a stop) occurs. No number is in
both. Both are computed once, over whole texts of all documents, and stored.

Each view has a logistic classifier, first trained on labelled rows. In each
round both score all unlabelled documents; the ``grow`` that a view is surest
of per class, if surer than ``CONFIDENT``, join the other view's training set as
pseudo-labels. Growth per round is a parameter of co-training, so the training
sets stay bounded. At the end each view is calibrated on labelled rows that
trained neither (Platt scaling) and the document's score is the sum of both
calibrated log-odds, less the prior that both contain.

Labels are learned from rows whose crc32(doc_id as text) modulo 5 is not 0, at
most about ``max_labelled`` of them; those with remainder 4 calibrate.

Defined cases: null and empty texts have empty content and zero layout and are
scored; null source or language is a value of its own. Without labels of both
kinds every score is the share of good labels (0.5 if there are none). Repeated
doc_ids are scored row by row and learned from once; a doc_id labelled twice
counts with the smaller label. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import TASK_MEMORIES, few_tasks, map_arrow, materialize, text_or_empty, values_of
from .shingles import CACHE_WORDS, fold_words, word_hashes

CONTENT = 256
LAYOUT = 14
HASHED = 48
SHAPES = 128
META = LAYOUT + HASHED + SHAPES
ROUNDS = 3
GROW = 100
CONFIDENT = 0.98
MAX_LABELLED = 8_000
HELD_OUT = 5


def content_view(text: str) -> np.ndarray:
    """Square roots of the shares of hashed words."""
    words = fold_words(text)
    if not words:
        return np.zeros(CONTENT, dtype=np.float32)
    return np.sqrt(np.bincount((word_hashes(words) % np.uint64(CONTENT)).astype(np.int64), minlength=CONTENT) / len(words)).astype(np.float32)


_KINDS = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c > 127 else 48 if 48 <= c <= 57 else c for c in range(256))
_SHAPES: dict[bytes, int] = {}
TASK_MEMORIES.append(_SHAPES)


def shapes(raw: bytes) -> list[bytes]:
    """The shape of each word: a run of letters, capitals or digits as one sign, other signs as they are, at most twice in a row."""
    a = np.frombuffer(raw.translate(_KINDS), dtype=np.uint8)
    same = a[1:] == a[:-1]
    drop = np.zeros(len(a), dtype=bool)
    drop[1:] = same & np.isin(a[1:], (65, 97, 48))
    drop[2:] |= same[1:] & same[:-1]
    return a[~drop].tobytes().split()


def _shape_buckets(found: list[bytes], buckets: int) -> np.ndarray:
    """The hash of each whole shape; shapes seen before are remembered."""
    known = _SHAPES
    try:
        return np.fromiter(map(known.__getitem__, found), dtype=np.int64, count=len(found))
    except KeyError:
        if len(known) > CACHE_WORDS:
            known.clear()
        known.update((w, zlib.crc32(w) % buckets) for w in set(found) if w not in known)
        return np.fromiter(map(known.__getitem__, found), dtype=np.int64, count=len(found))


def layout_view(text: str, lang, source) -> np.ndarray:
    """Layout measures, hashed source and language, then square roots of the shares of hashed word shapes."""
    out = np.zeros(META, dtype=np.float32)
    n = len(text)
    if n:
        raw = text.encode("utf-8", "surrogatepass")
        a = np.frombuffer(raw, dtype=np.uint8)
        lines = [x for x in raw.split(b"\n") if x]
        counts = np.bincount(a, minlength=256)
        upper, lower, digit, space = counts[65:91].sum(), counts[97:123].sum() + counts[128:].sum(), counts[48:58].sum(), counts[[9, 10, 13, 32]].sum()
        signs = len(a) - upper - lower - digit - space
        size = [len(x) for x in lines] or [0]
        out[:LAYOUT] = [np.log1p(n) / 10, np.log1p(len(lines)) / 5, np.log1p(np.mean(size)) / 8, np.std(size) / (1 + np.mean(size)), upper / len(a), digit / len(a), signs / len(a), space / len(a), 1 - len(set(lines)) / max(1, len(lines)), counts[46] / len(a), counts[33] / len(a), counts[124] / len(a), (counts[35:43].sum() - counts[39]) / len(a), 1.0]
        found = shapes(raw)
        if found:
            out[LAYOUT + HASHED :] = np.sqrt(np.bincount(_shape_buckets(found, SHAPES), minlength=SHAPES) / len(found))
    for tag, value in (("l", lang), ("s", source)):
        out[LAYOUT + zlib.crc32(f"{tag}:{value}".encode()) % HASHED] += 1
    return out


def views(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, content (CONTENT halves as binary) and meta (META halves as binary) of every document."""
    import pyarrow as pa

    def compute(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids, texts, lang, source = part.columns
                c = [content_view(t).astype(np.float16).tobytes() for t in values_of(texts)]
                m = [layout_view(t, x, y).astype(np.float16).tobytes() for t, x, y in zip(values_of(texts), lang.to_pylist(), source.to_pylist())]
                yield pa.RecordBatch.from_arrays([ids, pa.array(c, pa.binary()), pa.array(m, pa.binary())], names=["doc_id", "content", "meta"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return map_arrow(d, compute, "doc_id long, content binary, meta binary")


def _matrix(values, width: int) -> np.ndarray:
    x = np.frombuffer(b"".join(values), dtype=np.float16).reshape(-1, width).astype(np.float64)
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def train(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 25) -> np.ndarray:
    """Logistic coefficients by Newton steps; both classes weigh alike in part."""
    w = np.zeros(x.shape[1])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-5:
            break
    return w


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn a view's log-odds into calibrated ones, drawn towards 1 and 0."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - y) * z).sum() + (a - 1), (p - y).sum() + b * 0.1])
        v = p * (1 - p)
        h = np.array([[(v * z * z).sum() + 1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.1]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - step[0], b - step[1]
    return max(0.0, float(a)), float(b)


def _scored(table: DataFrame, wc: np.ndarray, wm: np.ndarray) -> DataFrame:
    """doc_id and the log-odds of both views for each stored document."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            zc, zm = (_matrix(b.column(1).to_pylist(), CONTENT) @ wc, _matrix(b.column(2).to_pylist(), META) @ wm) if b.num_rows else (np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(zc), pa.array(zm)], names=["doc_id", "zc", "zm"])

    return map_arrow(table.select("doc_id", "content", "meta"), run, "doc_id long, zc double, zm double")


def _unlabelled(table: DataFrame, labelled: DataFrame, wc: np.ndarray, wm: np.ndarray, limit: float) -> DataFrame:
    """doc_id and log-odds of the unlabelled documents of which a view is sure; scored before the join, so that it shuffles numbers and never views."""
    sure = _scored(table.filter("doc_id is not null"), wc, wm).filter((F.abs("zc") >= limit) | (F.abs("zm") >= limit))
    return sure.join(labelled.select("doc_id"), "doc_id", "left_anti")


def _one_row():
    """Of the rows that share a doc_id, the views of one."""
    return F.min(F.struct("content", "meta")).alias("v")


def _surest(pool: DataFrame, limit: float, grow: dict[float, int]) -> list:
    """For each teacher the ``grow[class]`` surest documents of each class, in one pass: each task keeps as many, then each of 256 parts, then all."""
    import pyarrow as pa

    def best(batches):
        kept: dict = {}
        for b in batches:
            ids = b.column(0).to_numpy()
            for k, teacher in ((1, "zc"), (2, "zm")):
                z = b.column(k).to_numpy()
                for sign, value in ((1, 1.0), (-1, 0.0)):
                    at = np.flatnonzero(sign * z >= limit)
                    old_z, old_i = kept.get((teacher, value), (z[:0], ids[:0]))
                    all_z, all_i = np.concatenate([old_z, sign * z[at]]), np.concatenate([old_i, ids[at]])
                    order = np.lexsort((all_i, -all_z))[: grow[value]]
                    kept[teacher, value] = all_z[order], all_i[order]
        rows = [(t, v, float(z), int(i)) for (t, v), (zs, ids) in kept.items() for z, i in zip(zs, ids)]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.float64(), pa.int64()))], names=["teacher", "value", "z", "doc_id"])

    some = map_arrow(pool.select("doc_id", "zc", "zm"), best, "teacher string, value double, z double, doc_id long")
    top = some.distinct().withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(256)))
    for group in (["teacher", "value", "part"], ["teacher", "value"]):
        place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("z"), "doc_id"))
        top = top.withColumn("n", place).filter(F.col("n") <= F.when(F.col("value") == 1, grow[1.0]).otherwise(grow[0.0]))
    top = top.groupBy("teacher", "value").agg(F.collect_list(F.struct("z", "doc_id")).alias("best"))
    return top.orderBy("teacher", F.desc("value")).collect()


def fit(table: DataFrame, labels: DataFrame, label: str = "quality", rounds: int = ROUNDS, grow: int = GROW, max_labelled: int = MAX_LABELLED, confident: float = CONFIDENT):
    """Coefficients of both views, their calibrations and the prior; or (None, share) without both labels."""
    y = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    y = y.groupBy("doc_id").agg(F.min("label").alias("label"))
    n = y.count()
    fold = F.crc32(F.col("doc_id").cast("string")) % HELD_OUT
    share = 1.0 if n <= max_labelled else max_labelled / n
    some = y.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * share)).withColumn("fold", fold).filter("fold != 0")
    rows = table.join(F.broadcast(some), "doc_id").groupBy("doc_id", "label", "fold").agg(_one_row()).select("doc_id", "label", "fold", "v.content", "v.meta").collect()  # bounded by max_labelled
    rows.sort(key=lambda r: r["doc_id"])
    truth = np.array([float(r["label"] == 1) for r in rows])
    folds = np.array([r["fold"] for r in rows])
    seed, test = folds != 4, folds == 4
    if not 0 < truth[seed].sum() < seed.sum():
        return None, float(truth.mean()) if len(truth) else 0.5
    xc, xm = _matrix([r["content"] for r in rows], CONTENT), _matrix([r["meta"] for r in rows], META)
    tc, tm, yc, ym = xc[seed], xm[seed], truth[seed], truth[seed]
    limit = float(np.log(confident / (1 - confident)))
    good = float(truth[seed].mean())
    sizes = {1.0: max(1, round(grow * good)), 0.0: max(1, round(grow * (1 - good)))}
    used: list[int] = []
    for _ in range(rounds):
        wc, wm = train(tc, yc), train(tm, ym)
        pool = _unlabelled(table, y, wc, wm, limit)
        if used:
            pool = pool.filter(~F.col("doc_id").isin(used))
        chosen = []
        for r in _surest(pool, limit, sizes):
            chosen += [(i, r["teacher"], r["value"]) for _, i in r["best"]]
        ids = sorted({i for i, _, _ in chosen})
        if not ids:
            break
        used += ids
        view = {r["doc_id"]: r["v"] for r in table.filter(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(_one_row()).collect()}  # at most 4 * grow documents
        for teacher in ("zc", "zm"):
            mine = [(view[i], value) for i, t, value in chosen if t == teacher]
            if mine and teacher == "zc":
                tm, ym = np.concatenate([tm, _matrix([r["meta"] for r, _ in mine], META)]), np.concatenate([ym, [v for _, v in mine]])
            elif mine:
                tc, yc = np.concatenate([tc, _matrix([r["content"] for r, _ in mine], CONTENT)]), np.concatenate([yc, [v for _, v in mine]])
    wc, wm = train(tc, yc), train(tm, ym)
    held = test if 0 < truth[test].sum() < test.sum() else seed
    cc, cm = platt(xc[held] @ wc, truth[held]), platt(xm[held] @ wm, truth[held])
    prior = np.clip(truth.mean(), 0.01, 0.99)
    return (wc, wm, cc, cm), float(np.log(prior / (1 - prior)))


def score(table: DataFrame, model, prior: float) -> DataFrame:
    """doc_id, held_out, content_score, meta_score, score, predicted and kept (predicted good) of every stored document."""
    held = (F.crc32(F.col("doc_id").cast("string")) % HELD_OUT == 0).alias("held_out")
    if model is None:
        p = F.lit(prior)
        return table.select("doc_id", held, p.alias("content_score"), p.alias("meta_score"), p.alias("score"), (p >= 0.5).cast("int").alias("predicted"), (p >= 0.5).alias("kept"))
    wc, wm, (ac, bc), (am, bm) = model
    z = _scored(table, wc, wm).withColumn("c", F.col("zc") * ac + bc).withColumn("m", F.col("zm") * am + bm)
    p = lambda x: 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))
    z = z.withColumn("score", p(F.col("c") + F.col("m") - prior))
    return z.select("doc_id", held, p(F.col("c")).alias("content_score"), p(F.col("m")).alias("meta_score"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= 0.5).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: quality of all documents."""
    table = materialize(views(spark.read.parquet(f"{sf_dir}/documents.parquet")), "views")
    return score(table, *fit(table, spark.read.parquet(f"{sf_dir}/labels.parquet")))
