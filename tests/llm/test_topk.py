import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.llm import topk
from sheafline.llm.common import Workspace


def brute(rows, every=20, k=20):
    ok = [(i, [math.floor(64 * c) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for qi, q in ok:
        if qi % every == 0:
            got = sorted((-sum(a * b for a, b in zip(q, c)), i) for i, c in ok if i != qi and len(c) == len(q))[:k]
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(got)]
    return sorted(out)


def run(spark, rows, every=20, **options):
    df = spark.createDataFrame([(i, v, "z", 1) for i, v in rows], "vec_id long, embedding array<double>, unit string, size int")
    return sorted(map(tuple, topk.top_scores(df, Workspace(spark, "t"), F.col("vec_id") % every == 0, **options).collect()))


def clustered(n, dims, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims))
    x = centres[rng.integers(0, 12, n)] + spread * rng.standard_normal((n, dims))
    return [(i, r) for i, r in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).tolist())]


@pytest.mark.parametrize(("n", "dims", "options"), [
    (0, 4, {}), (1, 4, {}), (15, 4, {}), (600, 8, {"subtree": 50, "page": 8, "block": 7}), (600, 8, {"subtree": 64, "page": 16, "routes": 2}), (900, 32, {}),
])
def test_against_brute_force(spark, n, dims, options):
    rows = clustered(n, dims, n + dims)
    assert run(spark, rows, **options) == brute(rows)


def test_odd_rows(spark):
    nan = float("nan")
    rows = clustered(60, 4, 3) + [
        (100, None), (120, []), (140, [1.0, None, 0.0, 0.0]), (160, [nan, 0.0, 0.0, 0.0]), (180, [float("inf"), 0.0, 0.0, 0.0]), (200, [0.0] * 4), (220, [1e3, -1e3, 5.5, 0.0]),
        (None, [1.0, 0.0, 0.0, 0.0]), (240, [1.0, 2.0]), (260, [3.0, -1.0]), (300, [1e7, 1e7, 1e7, 1e7]),
    ]
    assert run(spark, rows, subtree=16, page=4) == brute(rows)


def test_many_copies_and_ties(spark):
    """A third of the rows are one vector: ties go to the smaller ids, over several subtrees and pages."""
    rows = clustered(200, 6, 5) + [(1000 + i, [0.5] * 6) for i in range(300)]
    assert run(spark, rows, every=50, subtree=32, page=8, block=3) == brute(rows, 50)


def test_repeated_ids(spark):
    """Rows that repeat a query's id are queries each, and candidates for others each."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [0.5, 2.0]), (2, [1.0, 0.0])]
    assert run(spark, rows) == brute(rows)


def test_distances_are_avoided():
    """In tight clusters most entries are ruled out by stored distances."""
    rows = clustered(4000, 8, 7, 0.02)
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64)
    most = int((x * x).sum(axis=1).max())
    ids = np.arange(len(x))
    pages = list(topk.make_pages(ids, x, most, x[0], 64))
    assert sorted(np.concatenate([p.ids for p in pages]).tolist()) == ids.tolist()
    assert all(len(p.ids) <= 64 for p in pages)
    q = ids[::400]
    rows, computed = topk.search(pages, x[0], most, q, x[q], np.full(len(q), topk.NOTHING), 5)
    assert computed < len(q) * len(x) / 2
    for j, i in enumerate(q):
        want = sorted((-(x[i] @ x[c]), c) for c in ids if c != i)[:5]
        assert [(s, c) for w, s, c in rows.tolist() if w == j] == [(int(s), int(c)) for s, c in want]


def test_products_are_exact():
    a, b = np.array([[2**31, 1]]), np.array([[2**31 - 1, 1]])
    assert topk.products(a, b)[0, 0] == 2**31 * (2**31 - 1) + 1


def test_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    want = con.sql(topk.ORACLE)
    got = topk.op13_exact_top_k(spark, sf)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
