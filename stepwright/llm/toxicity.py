"""Toxicity by noisy-channel deobfuscation.

A character language model (trigrams over 28 symbols: a to z with accents
folded, any other letter, a boundary) is counted over the whole texts of all
documents. Tokens that look disguised are decoded: digits and signs stand for
letters and a run of a letter stands for one or two. In a row of single
characters each separator is dropped or parts two words, so the row is decoded
into words. Each token or row is a lattice of such readings, whatever its
length, and Viterbi search finds the reading that is likeliest under channel
and model.

Restored texts are scored: indicators are words and word beginnings of 3 to 6
letters that labelled toxic documents have far more often than clean ones (a
likelihood-ratio test). A logistic function of the strongest indicators of a
document, fitted on labelled rows that did not choose the indicators, gives
a score; after that fit the indicators are chosen anew from all of them. A
single indicator whose precision on labelled rows is sure (a lower bound at four
deviations of at least ``SURE``) is enough: the score is the larger of both.

Labels are learned from rows whose crc32(doc_id as text) modulo 5 is not 0; of
these at most about ``max_labelled`` are taken, by a hash of doc_id. All
documents are scored. Text is the only input of a score.

Defined cases: null, empty and wordless texts have no indicator and get the
score of such documents. Without labels, or with one label only, every score
is the share of toxic labels (0 if there are none). Repeated doc_ids are scored
row by row; a doc_id labelled twice counts with the larger label. Other columns
pass through ``remove_toxic``.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TASK_MEMORIES, discard, map_arrow, materialize, text_or_empty, values_of

MAX_LABELLED = 20_000
MIN_RATIO = 12.0
#: Deviations below an indicator's precision that still count as sure.
SURE_Z, SURE = 4.0, 0.8
CACHE_TOKENS = 100_000
#: Indicators that a task counts before it hands the counts on.
FLUSH_INDICATORS = 80_000
HELD_OUT = 5

SYMBOLS, OTHER, EDGE = 28, 26, 27
#: The letters that digits and signs stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
LEET_COST, COLLAPSE_COST, DROP_COST = -1.2, -0.4, -15.0

#: A row of single characters, leet signs among them, with up to three separators between two; quotes and stops may stand around it.
_SPACED = re.compile(r"(?<![^\s\"'\[{<])(?:(?:[^\W_]|[@$!|+(€£])[\s.\-_*]{1,3}){2,}(?:[^\W_]|[@$!|+(€£])(?=[.,;:!?\"')\]}>]*(?:\s|$))")
_SEPARATORS = re.compile(r"[\s.\-_*]+")
_DISGUISED = re.compile(r"[0-9@$!|+(€£]|(.)\1")
#: Signs at the ends of a token that stand for no letter.
_ENDS = "\"'()[]{}<>.,;:?%&*#~^=/\\-_`"
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _fold_table() -> np.ndarray:
    """Symbol of each code point below 0x250."""
    import unicodedata

    table = np.full(0x250, EDGE, dtype=np.int64)
    for c in range(0x250):
        if chr(c).isalpha():
            base = unicodedata.normalize("NFD", chr(c))[0].lower()
            table[c] = ord(base) - 97 if "a" <= base <= "z" else OTHER
    return table


_FOLD = _fold_table()


def symbols_of(text: str) -> np.ndarray:
    """The text as symbols of the language model."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(c < 0x250, _FOLD[np.minimum(c, 0x24F)], OTHER)


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of symbol trigrams over all texts; 28**3 numbers whatever the corpus."""
    import pyarrow as pa

    def count(batches):
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for b in batches:
            for t in values_of(b.column(0)):
                if t:
                    s = np.concatenate([[EDGE], symbols_of(t), [EDGE]])
                    total += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"k": pa.array(k), "n": pa.array(total[k])})

    counts = np.zeros(SYMBOLS**3, dtype=np.int64)
    for r in map_arrow(docs.select(text), count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        counts[r["k"]] = r["n"]
    return counts


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(symbol | two symbols before), smoothed by the bigram and the symbol."""
    tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + SYMBOLS)
    p2 = (bi + 4 * p1) / (bi.sum(axis=1, keepdims=True) + 4)
    p3 = (tri + 4 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 4)
    return np.log(p3)


class Restorer:
    """Viterbi decoding of disguised tokens under a language model."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each run of equal characters its readings as (letters, cost)."""
        out, i = [], 0
        while i < len(token):
            j = i
            while j < len(token) and token[j] == token[i]:
                j += 1
            c, n = token[i], j - i
            if c.isalpha():
                out.append([(c * n, 0.0)] if n == 1 else [(c, COLLAPSE_COST), (c * 2, 0.0 if n == 2 else COLLAPSE_COST)])
            else:
                letters = LEET.get(c, "")
                reads = [(x * k, LEET_COST * k) for x in letters for k in ((1,) if n == 1 else (1, 2))]
                out.append([*reads, ("", DROP_COST)] if reads else [("", COLLAPSE_COST)])
            i = j
        return out

    def row_lattice(self, row: str) -> list[list[tuple[str, float]]]:
        """As ``lattice`` for a row of single characters: between two of them a boundary (a space) or nothing."""
        out, chars, i = [], _SEPARATORS.sub("", row), 0
        while i < len(chars):
            j = i
            while j < len(chars) and chars[j] == chars[i]:
                j += 1
            if out:
                out.append([("", 0.0), (" ", 0.0)])
            reads = self.lattice(chars[i:j])[0]
            if j - i > 1:  # a boundary inside the run
                reads = [*reads, *((x[0] + " " + x[1], cost) for x, cost in reads if len(x) == 2)]
            out.append(reads)
            i = j
        return out

    def decode_row(self, row: str) -> list[str]:
        """The words of the likeliest reading of a row of single characters."""
        return self._likeliest(self.row_lattice(row)).split()

    def decode(self, token: str) -> str:
        """The likeliest reading of one token."""
        return self._likeliest(self.lattice(token))

    def _likeliest(self, lattice: list[list[tuple[str, float]]]) -> str:
        best: dict = {(EDGE, EDGE): (0.0, None)}
        for reads in lattice:
            now: dict = {}
            for (a, b), (score, said) in best.items():
                for letters, cost in reads:
                    x, y, s = a, b, score + cost
                    for c in letters:
                        z = int(_FOLD[ord(c)]) if ord(c) < 0x250 else OTHER
                        s += self.model[x][y][z]
                        x, y = y, z
                    if (x, y) not in now or now[x, y][0] < s:
                        now[x, y] = (s, (said, letters))
            best = now

        def spelled(said) -> str:
            parts = []
            while said is not None:
                said, letters = said
                parts.append(letters)
            return "".join(reversed(parts))

        return max((s + self.model[a][b][EDGE], spelled(said)) for (a, b), (s, said) in best.items())[1]


def words_to_score(text: str, restore) -> set[str]:
    """The distinct words of the text and of what rows of single characters may stand for; ``restore`` reads a token."""
    low = text.lower()
    found = set()
    for t in set(low.split()):
        found.update(restore(t))
    for m in _SPACED.finditer(low):
        found.update(restore(m.group()))
    return found


def readings(token: str, restorer: Restorer) -> tuple[str, ...]:
    """The word of a token without signs at its ends and, if it looks disguised, its likeliest readings with and without them.

    A row of single characters has the words that it is decoded into, and all of it as one word.
    """
    disguised = _DISGUISED.search(token)
    if not disguised and not _SEPARATORS.search(token):
        core = token.strip(_STRIP)
        return (core,) if core else ()
    if _SPACED.fullmatch(token):
        if not any(c.isalpha() for c in token):
            return ()
        joined = _SEPARATORS.sub("", token)
        return tuple(x for x in {*restorer.decode_row(token), joined, restorer.decode(joined)} if x)
    core = token.strip(_STRIP)
    found = {core}
    if disguised:
        for bare in {core, token.strip(_ENDS)}:
            if len(bare) > 2 and any(c.isalpha() for c in bare) and _DISGUISED.search(bare):
                found.add(restorer.decode(bare))
    return tuple(x for x in found if x)


def _beginnings(word: str) -> set[str]:
    """The first three letters of every reading of a word of letters: those of its first three runs, once or twice each."""
    out, i = {""}, 0
    for _ in range(3):
        if i == len(word):
            break
        j, c = i + 1, word[i]
        while j < len(word) and word[j] == c:
            j += 1
        out = {x + y for x in out for y in ((c,) if j == i + 1 else (c, c * 2))}
        i = j
    return {x[:3] for x in out}


def indicators_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in range(3, 7) if len(word) > k)]


def is_held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % HELD_OUT == 0


def _labelled(docs: DataFrame, labels: DataFrame, label: str, text: str, max_labelled: int) -> DataFrame:
    """(text, label, fold) of the labelled rows that may be learned from, about ``max_labelled`` at most.

    That bound on the ids lets them go to all tasks, so no text is shuffled.
    """
    y = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    y = y.groupBy("id").agg(F.max("label").alias("label")).withColumn("fold", F.crc32(F.col("id").cast("string")) % HELD_OUT).filter("fold != 0")
    n = y.count()
    if n > max_labelled:
        y = y.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * max_labelled / n))
    return docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty(text).alias("text")).join(F.broadcast(y), "id").select("text", "label", "fold")


class Scorer:
    """The fitted model: language model, indicator weights and the logistic function over a document's strongest ones."""

    def __init__(self, model: np.ndarray, weights: dict[str, tuple[float, float]]):
        self.restorer = Restorer(model)
        self.use(weights)
        self.coefficients = np.array([-4.0, 0.6, 0.3, 0.3, 0.3])
        self.base = None
        self._tokens: dict[str, tuple] = {}

    def use(self, weights: dict[str, tuple[float, float]]) -> None:
        """Take these indicators. Their first three letters tell most words apart from all of them."""
        self.weights, self.heads = weights, {k.rstrip("*")[:3] for k in weights}

    def __getstate__(self):
        return self.__dict__ | {"_tokens": {}}

    def __setstate__(self, state):
        self.__dict__.update(state)
        TASK_MEMORIES.append(self._tokens)

    def _weight(self, token: str) -> tuple[float, float]:
        """The largest weight and the largest sure precision of what a token may be.

        A token of letters alone is decoded only if one of its readings may begin as an
        indicator does: runs of a letter are read as one or two of it and nothing else changes.
        """
        bare = token.strip(_ENDS)
        if bare.isalpha() and bare[:3] not in self.heads and self.heads.isdisjoint(_beginnings(bare)):
            return 0.0, 0.0
        found = [self.weights[x] for w in readings(token, self.restorer) if w[:3] in self.heads for x in indicators_of(w) if x in self.weights]
        return (max(w for w, _ in found), max(p for _, p in found)) if found else (0.0, 0.0)

    def strongest(self, text: str | None) -> list[float]:
        """The two largest token weights, the logs of how many tokens have one and how often they occur, and the largest sure precision."""
        if not text:
            return [0.0] * 5
        low, known = text.lower(), self._tokens
        tokens = Counter(low.split())
        tokens.update(m.group() for m in _SPACED.finditer(low))
        if len(known) > CACHE_TOKENS:
            known.clear()
        found, times, sure = [], 0, 0.0
        for t, n in tokens.items():
            w = known.get(t)
            if w is None:
                w = known[t] = self._weight(t)
            if w[0]:
                found.append(w[0])
                sure = max(sure, w[1])
                times += n
        found.sort(reverse=True)
        return [found[0] if found else 0.0, found[1] if len(found) > 1 else 0.0, math.log1p(len(found)), math.log1p(times), sure]

    def score(self, text: str | None) -> float:
        if self.base is not None:
            return self.base
        *x, sure = self.strongest(text)
        z = float(self.coefficients @ np.array([1.0, *x]))
        return max(sure, 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z)))))


def fit_logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Coefficients by Newton steps, drawn towards ``start``."""
    w = start.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * (w - start)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def choose_indicators(rows: DataFrame, restorer_model: np.ndarray) -> tuple[dict[str, tuple], int, int]:
    """Weights and sure precisions of the indicators by how much more toxic than clean documents have them; and both numbers of documents."""
    import pyarrow as pa

    shared = rows.sparkSession.sparkContext.broadcast(Restorer(restorer_model))

    def count(batches):
        toxic, clean, n = Counter(), Counter(), [0, 0]
        memory: dict = {}

        def read(t):
            if t not in memory:
                if len(memory) > CACHE_TOKENS:
                    memory.clear()
                memory[t] = readings(t, shared.value)
            return memory[t]

        def flush():
            keys = list(toxic.keys() | clean.keys())
            out = pa.RecordBatch.from_pydict({"k": keys, "t": pa.array([toxic[k] for k in keys], pa.int64()), "c": pa.array([clean[k] for k in keys], pa.int64())})
            toxic.clear()
            clean.clear()
            return out

        for b in batches:
            for t, label in zip(values_of(b.column(0)), values_of(b.column(1))):
                n[label == 1 and 1 or 0] += 1
                found = {x for w in words_to_score(t, read) for x in indicators_of(w)}
                (toxic if label == 1 else clean).update(found)
                if len(toxic) + len(clean) > FLUSH_INDICATORS:
                    yield flush()
        toxic[""], clean[""] = n[1], n[0]
        yield flush()

    counts = map_arrow(rows.select("text", "label"), count, "k string, t long, c long").groupBy("k").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counts = counts.filter("k = '' or t >= 3").persist()
    n = counts.filter("k = ''").select("t", "c").first() or (0, 0)
    nt, nc = n[0], n[1]
    if not nt or not nc:
        counts.unpersist()
        shared.destroy()
        return {}, nt, nc

    def xlogx(k, whole):
        return F.when(k > 0, k * F.log(k / whole)).otherwise(0.0)

    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    every = (t + c) / (nt + nc)
    ratio = 2 * (xlogx(t, nt * every) + xlogx(c, nc * every) + xlogx(nt - t, nt * (1 - every)) + xlogx(nc - c, nc * (1 - every)))
    weight = F.log(((t + 0.5) / (nt + 1)) / ((c + 0.5) / (nc + 1)))
    n, p, zz = t + c, t / (t + c), SURE_Z**2
    sure = (p + zz / (2 * n) - SURE_Z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)
    best = counts.filter("k != ''").withColumn("weight", weight).withColumn("sure", F.when(sure >= SURE, sure).otherwise(0.0)).withColumn("ratio", ratio).filter(f"ratio >= {MIN_RATIO} and weight > 1.5")
    chosen = {r["k"]: (r["weight"], r["sure"]) for r in best.collect()}  # at most the words of max_labelled documents
    counts.unpersist()
    shared.destroy()
    return chosen, nt, nc


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", max_labelled: int = MAX_LABELLED) -> Scorer:
    """Count the language model over all documents and learn the labels."""
    import pyarrow as pa

    model = language_model(count_trigrams(docs, text))
    rows = materialize(_labelled(docs, labels, label, text, max_labelled), "labelled")
    weights, nt, nc = choose_indicators(rows.filter("fold != 4"), model)
    scorer = Scorer(model, weights)
    if not nt or not nc:
        scorer.base = nt / (nt + nc) if nt + nc else 0.0
        discard(rows)
        return scorer
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def measure(batches):
        for b in batches:
            x = [shared.value.strongest(t) for t in values_of(b.column(0))]
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.list_(pa.float64())), "y": b.column(1).cast(pa.int32())})

    sample = map_arrow(rows.filter("fold = 4").select("text", "label"), measure, "x array<double>, y int").collect()  # bounded by max_labelled
    shared.destroy()
    if sample:
        x = np.array([[1.0, *r["x"][:-1]] for r in sample])
        y = np.array([float(r["y"] == 1) for r in sample])
        if 0 < y.sum() < len(y):
            scorer.coefficients = fit_logistic(x, y, scorer.coefficients)
    scorer.use(choose_indicators(rows, model)[0])
    discard(rows)
    return scorer


def score(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for b in batches:
            s = [shared.value.score(t) for t in values_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([is_held_out(i) for i in b.column(0).to_pylist()]), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text), run, "doc_id long, held_out boolean, score double, predicted int")


def remove_toxic(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    import pyarrow as pa

    shared, at = docs.sparkSession.sparkContext.broadcast(scorer), docs.columns.index(text)

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array([shared.value.score(t) < 0.5 for t in values_of(b.column(at))], pa.bool_()))

    return map_arrow(docs, keep, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: toxicity of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
