"""Token counts, centroid clustering and ranked search against their library or brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stepwright.llm import lexical_search, token_counts, yinyang

from .conftest import edge_documents, edge_vectors, prose

# -- token counts --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def counter():
    return token_counts.Compiled(token_counts.default_tokenizer())


def by_library(c, texts):
    return token_counts._library_counts(c.library, texts)


PARTS = ["a", "'s", "'re", "'r", "'l", "'ll", "r", "e", " ", "  ", "\n", "\t", "é", "漢", "1", "2٣", "!", "'", "''", " ", "　", "🎉", "<|endoftext|>", "<|", "the", " of", "ت", "T", "\x00", "\x1c", "\x85", "²", "½", "x" * 70]


@given(st.lists(st.sampled_from(PARTS), max_size=25))
@settings(max_examples=400, deadline=None)
def test_counts_agree_with_the_library(counter, parts):
    text = "".join(parts)
    assert counter.counts([text]) == by_library(counter, [text])


@given(st.text(alphabet="etaoinshrdlu ETAOIN-_=*#.,0123\n", max_size=200))
@settings(max_examples=300, deadline=None)
def test_counts_of_unseen_words_agree(counter, text):
    assert counter.counts([text]) == by_library(counter, [text])


def test_counts_of_every_kind_of_character(counter):
    texts = [chr(i) + chr(i) + " " + chr(i) + "a1" for i in range(0, 0x20000, 7) if not 0xD800 <= i < 0xE000]
    assert counter.counts(texts) == by_library(counter, texts)


def test_long_texts_and_long_words(counter, monkeypatch):
    monkeypatch.setattr(token_counts, "SLAB", 700)
    texts = [prose(1, 5000), "ab" * 3000, "", " " * 2000, "漢字" * 900, ("x'll 'r " * 400) + "'"]
    assert counter.counts(texts) == by_library(counter, texts)
    pieces = token_counts._cut(texts[0], 700)
    assert "".join(pieces) == texts[0] and len(pieces) > 10


def test_table_of_transitions_starts_anew(counter, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_MOVES", 300)
    texts = [prose(i, 200) for i in range(20)]
    assert [n for t in texts for n in counter.counts([t])] == by_library(counter, texts)


def test_chunk_maps_compose(counter):
    rng, s = np.random.default_rng(1), counter.splitter
    classes = rng.integers(0, token_counts.N_CLASSES, 5000).astype(np.uint8)
    state, marks = token_counts.START, np.zeros(5001, dtype=bool)
    for i, c in enumerate(classes.tolist()):
        state, m = token_counts._move(state, c)
        marks[i] |= bool(m & token_counts.HERE)
        if m & token_counts.BEFORE:
            marks[i - 1] = True
    assert (s.starts(classes) == marks[:-1]).all()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_are_counted_by_their_library(name):
    import public_tokenizers

    c = token_counts.Compiled(public_tokenizers.path(name))
    assert c.counter is None
    assert c.counts(["", "Two words"])[0] == 0 and c.counts(["Two words"])[0] >= 2


def test_token_count_query_against_the_library(spark, edge_dir, counter):
    docs = edge_documents()
    texts = [t if isinstance(t, str) else "" for t in docs.text]
    want = [(i, len(t.encode()), n, n > 1024) for i, t, n in zip(docs.doc_id.tolist(), texts, by_library(counter, texts))]
    got = [(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.query(spark, edge_dir).collect()]
    assert sorted(got) == sorted(want)


# -- clustering ----------------------------------------------------------------------------------------------------


def plain_rounds(points, centers, rounds):
    """Assign and average with Python's integers."""
    points, centers = [list(map(int, p)) for p in points], [list(map(int, c)) for c in centers]
    nearest = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, c)), k) for k, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for p in points:
            groups.setdefault(nearest(p)[1], []).append(p)
        for k, g in groups.items():
            centers[k] = [sum(x) // len(g) for x in zip(*g)]
    return [nearest(p) for p in points], centers


@pytest.mark.parametrize("spread,scale", [(3, 1), (200, 1), (3, 4_000_000)])
def test_bounds_give_the_nearest_centroid_with_ties(spread, scale):
    rng = np.random.default_rng(spread)
    points = (rng.integers(-spread, spread, (300, 4)) * scale).astype(np.int64)
    centers = points[:12].copy()
    group = yinyang.group_centroids(centers, 3)
    x, old = yinyang.Bounds(points), None
    for turn in range(6):
        x.first(centers, group) if old is None else x.move(old, centers, group)
        d = yinyang.squared(points, centers)
        assert (x.cluster == d.argmin(axis=1)).all()
        own = np.sqrt(d[np.arange(len(d)), x.cluster].astype(float))
        assert (x.upper >= own * (1 - 1e-9)).all()
        others = np.sqrt(d.astype(float))
        others[np.arange(len(d)), x.cluster] = np.inf
        for g in range(group.max() + 1):
            assert (x.lower[:, g] <= others[:, group == g].min(axis=1) * (1 + 1e-9) + 1e-6).all()
        old, centers = centers, centers.copy()
        for k in range(len(centers)):
            if (x.cluster == k).any():
                centers[k] = points[x.cluster == k].sum(axis=0) // (x.cluster == k).sum()
    assert [c for _, c in plain_rounds(points, points[:12], 5)[0]] == x.cluster.tolist()


def test_bounds_spare_most_distances():
    rng = np.random.default_rng(5)
    heart = rng.integers(-5000, 5000, (20, 8))
    points = (heart[rng.integers(0, 20, 4000)] + rng.integers(-40, 40, (4000, 8))).astype(np.int64)
    centers = heart.astype(np.int64)
    group = yinyang.group_centroids(centers, 4)
    x = yinyang.Bounds(points)
    x.first(centers, group)
    after = x.scanned
    x.move(centers, centers + 1, group)
    assert x.scanned - after < 0.1 * len(points) * len(centers)


def test_cluster_query_against_plain_loops(spark, edge_dir):
    import hashlib

    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in edge_vectors() if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))[:40]
    found, centers = plain_rounds([v for _, v in kept], [v for _, v in first], 5)
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    sums = Counter()
    for d, c in found:
        sums[c] += d
    want = [(i, c, d, sums[c], sum(sums.values()), marks[c]) for (i, _), (d, c) in zip(kept, found)]
    got = [tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in yinyang.query(spark, edge_dir).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_components_too_large_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        yinyang.cluster(df)


# -- ranked search -------------------------------------------------------------------------------------------------


def plain_ranking(docs, items, k=10):
    """Every document scored for every item with Python's integers."""
    words = [lexical_search.words_of(t) for _, t in docs]
    n_docs, total = sum(1 for w in words if w), sum(map(len, words))
    held = [Counter(w) for w in words]
    df = Counter(t for c in held for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for at, ((doc_id, _), w, c) in enumerate(zip(docs, words, held)):
            s = 0
            for t in set(lexical_search.words_of(text)) & c.keys():
                m = 100 - 90 + (90 * len(w) * n_docs) // total
                s += lexical_search.term_weight(n_docs, df[t]) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, doc_id is not None, doc_id or 0, at))
        out += [(item_id, r + 1, d if some else None, -s) for r, (s, some, d, _) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("block_terms", [1, 25, 100_000])
def test_search_against_every_score(spark, block_terms):
    rng = random.Random(block_terms)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(vocabulary[min(59, int(rng.expovariate(0.12)))] for _ in range(n))
    docs = [(i // 2 if i % 9 else None, text(rng.randint(0, 40))) for i in range(250)] + [(900 + i, "w1 w2 w3") for i in range(30)] + [(990, None)]
    items = [(i % 7, text(rng.randint(1, 12))) for i in range(9)] + [(50, "w1 w2 w3"), (51, ""), (52, None), (53, "unknown"), (54, "w59 unknown"), (None, "w0")]
    found = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), block_terms=block_terms)
    got = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(plain_ranking(docs, items), key=str)


def test_pruning_leaves_out_terms_that_cannot_lift_a_document():
    rows = [{"rid": 0, "item_id": 1, "terms": ["common", "rare"]}]
    b = lexical_search.Block(rows, {"common": 90, "rare": 12}, 100, 1000)
    b.prune(np.array([10, 500]), np.array([200]))
    assert b.essential[1].tolist() == [0] and b.rest.tolist() == [10]
    assert lexical_search._meet(b.essential, np.array([b.terms["common"]]))[0].size == 0
    b.prune(np.array([10, 500]), np.array([10]))  # a document with the common term alone can reach it
    assert lexical_search._meet(b.essential, np.array([b.terms["common"]]))[0].size == 1
