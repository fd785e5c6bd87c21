"""The stages of the pipeline and the whole of it against brute force on small tables."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from stepwright.llm import token_store, toxicity

from .conftest import prose


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def words(text):
    return (text or "").replace("\x1f", "?").replace("\x1c", "?").split()


def shingles(text, k=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x1f", "?").split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups(rows):
    """The smallest row index of each row's group, by comparing all pairs."""
    sets, root = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(rows))]


def decon_words(text):
    out, now = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            out += [now] if now else []
            now = ""
        else:
            now += c.lower() if c.isascii() else c
    return out


def contaminated(text, items):
    w = decon_words(text)
    for item in items:
        v = decon_words(item)
        n = min(10, len(v))
        have = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        if any(tuple(w[i : i + n]) in have for i in range(len(w) - n + 1)):
            return True
    return False


@pytest.fixture(scope="module")
def stages(spark, edge_dir):
    """The rows before the pipeline and after each stage, as ``run`` has them."""
    from stepwright.llm.common import materialize

    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    found = [rows_of(docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, edge_dir), f"test-{name}")
        found.append(rows_of(docs))
    return found


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]


def test_toxic_documents_go(spark, edge_dir, stages):
    scorer = toxicity.fit(spark.read.parquet(f"{edge_dir}/documents.parquet"), spark.read.parquet(f"{edge_dir}/labels.parquet"))
    want = [r for r in stages[0] if scorer.score(r["text"]) < 0.5]
    assert sorted(map(str, stages[1])) == sorted(map(str, want))


def test_one_of_each_group_stays(stages):
    rows = sorted(stages[1], key=lambda r: r["doc_id"])
    want = {rows[i]["doc_id"] for i in groups(rows)}
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(want)


def test_documents_with_benchmark_windows_go(spark, edge_dir, stages):
    items = [r["text"] for r in spark.read.parquet(f"{edge_dir}/benchmark.parquet").collect()]
    assert sorted(r["doc_id"] for r in stages[3]) == sorted(r["doc_id"] for r in stages[2] if not contaminated(r["text"], items))


def test_mixed_copies_have_their_documents_words_in_order(stages):
    before, sizes, taken = {r["doc_id"]: r for r in stages[3]}, Counter(), Counter()
    for r in stages[3]:
        sizes[r["source"]] += len(words(r["text"]))
    for r in stages[4]:
        old = iter(words(before[r["doc_id"]]["text"]))
        assert all(any(w == x for x in old) for w in words(r["text"])) and r["source"] == before[r["doc_id"]]["source"]
        taken[r["source"]] += len(words(r["text"]))
    assert max(Counter(r["doc_id"] for r in stages[4]).values()) <= 3
    weights = {s: 1 + k % 3 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    left, targets = dict(sizes), {}
    while left:
        rest = sum(sizes.values()) - sum(targets.values())
        level = rest / sum(weights[s] for s in left)
        full = [s for s in left if level * weights[s] > 3 * sizes[s]]
        targets |= {s: 3 * sizes[s] for s in full} if full else {s: level * weights[s] for s in left}
        left = {s: n for s, n in left.items() if s in full} and {s: n for s, n in left.items() if s not in full} if full else {}
    assert all(abs(taken[s] - targets[s]) <= 3 * 64 + 0.02 * targets[s] for s in sizes)


def test_token_rows_are_those_of_the_mixed_documents(stages):
    tok, want = token_store.Encoder(token_store.default_tokenizer()).tok, []
    for r in stages[4]:
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want.append((r["doc_id"], len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    got = sorted(stages[5], key=lambda r: r["start"])
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]


def test_run_is_its_stages(spark, edge_dir, stages):
    assert sorted(map(str, rows_of(corpus_pipeline.run(spark, edge_dir)))) == sorted(map(str, stages[5]))


def test_run_without_rows(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []


def test_run_on_null_columns(spark, tmp_path):
    rows = [(None, None, None, None, None)] * 3 + [(None, prose(60, 50), None, None, 1), (5, None, "en", "a", 0), (None, prose(61, 80), "en", "a", 2), (5, prose(62, 70), "en", "a", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(None, 1, None), (5, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(str, corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))
    out = rows_of(corpus_pipeline.run(spark, str(tmp_path)))
    assert all(r["n_tokens"] > 1 for r in out) or out == []
