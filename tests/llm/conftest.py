import os

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = "the of and to in that for with this from by is was are be as at on it an".split()


def prose(seed: int, n: int) -> str:
    """n invented words, the same for the same seed."""
    x, out = seed * 2654435761 % 2**32, []
    for _ in range(n):
        x = (x * 1664525 + 1013904223) % 2**32
        w = WORDS[(x >> 16) % 20]
        out.append(w if (x >> 8) % 3 else w + WORDS[(x >> 20) % 20] + WORDS[(x >> 24) % 20])
    return " ".join(out)


def edge_documents() -> pd.DataFrame:
    """Null, empty, blank, one-word, very long, repeated, near-equal and clashing rows."""
    near = prose(7, 200).split()
    other = near.copy()
    other[50] = "changed"
    half = near[:100] + prose(8, 100).split()
    passage = prose(9, 60)
    rows = [
        (1, prose(1, 120)), (2, None), (3, ""), (4, "  \n\t "), (5, "word"), (6, "Three short words"), (7, " ".join(near)), (8, " ".join(other)), (9, " ".join(half)), (10, " ".join(near).upper()),
        (11, prose(2, 30) + " " + passage + " " + prose(3, 30)), (12, passage + "\n" + prose(4, 50)), (13, prose(5, 9000)), (14, prose(6, 40)), (14, prose(6, 40)), (15, "x " * 300), (16, "Ünïcödé wörds — “quotes” 漢字 " * 20),
        (17, "three SHORT words"), (18, "a,b. c"), (19, prose(10, 400)), (20, prose(11, 35)), (21, prose(11, 35)), (22, prose(11, 34)), (23, "tail\x00 null\x1f byte <|endoftext|> end"),
    ]
    df = pd.DataFrame(rows, columns=["doc_id", "text"])
    df["lang"] = ["en", None, "de"] * 8
    df["source"] = (["src0"] * 10 + ["src1", "src2", None] * 5)[: len(df)]
    df["n_chars"] = df["text"].map(lambda t: len(t) if isinstance(t, str) else 0)
    for clash in ("size", "rid", "path", "rep", "node", "digest", "page", "bucket", "host"):
        df[clash] = "extra"
    return df.astype({"doc_id": "int64", "n_chars": "int64"})


@pytest.fixture(scope="session")
def edge_dir(tmp_path_factory):
    """A folder with small tables that hold the odd cases."""
    d = tmp_path_factory.mktemp("edge")
    docs = edge_documents()
    docs.to_parquet(d / "documents.parquet")
    items = [(1, " ".join(docs.text[0].split()[10:40])), (2, docs.text[0].split()[5] + " of nothing else"), (3, None), (4, ""), (5, "word"), (6, passage_of(docs)), (6, passage_of(docs)), (70, "!!! ???")]
    pd.DataFrame(items, columns=["item_id", "text"]).to_parquet(d / "benchmark.parquet")
    pd.DataFrame({"doc_id": [1, 5, 6, 7, 9, 11, 12, 19, 14], "quality": [1, 1, 0, 1, 0, 1, 1, 0, 1], "toxic": [0, 0, 1, 0, 1, 0, 0, 0, None]}).astype({"toxic": "Int32", "quality": "int32"}).to_parquet(d / "labels.parquet")
    big = "<html><body><nav>menu</nav><article><h1>T</h1><p>" + prose(12, 50) + "</p></article></body></html>"
    pages = [(1, "http://www.A.example/x?b=1", big), (2, "http://a.example/y", big), (3, None, None), (4, "", ""), (5, "::odd::", "<p>short"), (6, "http://b.example:8080/", "<p>short"), (7, "http://a.example/x", big.replace("T", "U")), (8, "http://a.example/z\r\nX: y", "é&amp;<b>ü</b>" * 50), (8, "http://a.example/z\r\nX: y", "é&amp;<b>ü</b>" * 50)]
    pd.DataFrame(pages, columns=["page_id", "url", "html"]).to_parquet(d / "pages.parquet")
    vectors = edge_vectors()
    pq.write_table(pa.table({"vec_id": pa.array([i for i, _ in vectors], pa.int64()), "embedding": pa.array([v for _, v in vectors], pa.list_(pa.float32())), "cluster": ["extra"] * len(vectors)}), d / "embeddings.parquet")
    return str(d)


def edge_vectors() -> list[tuple]:
    """Equal, opposite, tied and repeated vectors, a null id, and vectors that are not kept."""
    unit = lambda i, x: [x if j == i else 0.0 for j in range(64)]
    kept = [(i, unit(i % 7, ((i * 37) % 11 - 5) / 8)) for i in range(120)] + [(5, unit(3, 0.5)), (5, unit(3, 0.5)), (None, unit(1, -2.0)), (999, [0.0] * 64)]
    nan, inf = float("nan"), float("inf")
    return kept + [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, unit(0, nan)), (205, unit(0, inf)), (206, unit(0, -inf)), (207, [None] + [1.0] * 63)]


def passage_of(docs) -> str:
    return " ".join(docs.text[10].split()[35:70])


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory, edge_dir):
    """The same tables without rows."""
    d = tmp_path_factory.mktemp("empty")
    for name in os.listdir(edge_dir):
        pq.write_table(pq.read_table(f"{edge_dir}/{name}").slice(0, 0), d / name)
    return str(d)


def sql_rows(sql: str, folder: str):
    """Columns and rows of DuckDB SQL over the tables of a folder."""
    c = duckdb.connect()
    for name in os.listdir(folder):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    q = c.sql(sql)
    return q.columns, q.fetchall()


def same(df, columns, rows, places: int = 6) -> None:
    """A DataFrame has these rows, in any order."""
    assert set(df.columns) == set(columns)
    norm = lambda v: round(v, places) if isinstance(v, float) else v
    key = lambda r: tuple(str(norm(r[c])) for c in sorted(columns))
    got = sorted(key(r.asDict()) for r in df.collect())
    assert got == sorted(key(dict(zip(columns, r))) for r in rows)
