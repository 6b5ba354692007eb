from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.llm import embedding_dedup, exact_dedup, ngram_join
from sheafline.llm.common import Workspace, components


def normal(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")


def exact(rows):
    groups = defaultdict(list)
    for i, x in rows:
        groups[normal(x)].append(i)
    out = []
    for i, x in rows:
        g = groups[normal(x)]
        keep = max((k for k in g if k is not None), default=None)
        out.append((i, keep, len(g), i is not None and i == keep))
    return sorted(map(repr, out))


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
@pytest.mark.parametrize("clash", [False, True])
def test_exact_groups(spark, request, which, clash):
    df = request.getfixturevalue(which)
    ident = (lambda c: F.xxhash64(c) % 3) if clash else F.xxhash64
    got = exact_dedup.exact_groups(df, Workspace(spark, "t"), ident=ident).collect()
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in got) == exact(rows)


def test_exact_runs_no_python_on_executors(spark, docs):
    plan = exact_dedup.exact_groups(docs, Workspace(spark, "t"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_exact_oracle(spark, docs, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    want = sorted(con.sql(exact_dedup.ORACLE).fetchall())
    assert sorted(map(tuple, exact_dedup.exact_groups(docs, Workspace(spark, "t")).collect())) == want


def test_drop_copies_keeps_columns(spark, odd):
    kept = exact_dedup.drop_copies(odd, Workspace(spark, "t"))
    assert kept.columns == odd.columns
    assert len([r for r in kept.collect() if normal(r.text) == "one"]) == 2  # the largest id, and the row without an id
    rows = [(1, "a b"), (1, "A B"), (1, "c"), (2, "a b"), (2, "a b"), (3, "d"), (3, "d"), (3, "d")]
    got = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t")).collect()
    assert sorted(map(tuple, got)) == [(1, "c"), (2, "a b"), (3, "d")]


def test_exact_texts_without_spaces_or_line_ends(spark):
    """Content decides where such texts are cut: one character more in front leaves most chunks as they are."""
    rng = np.random.default_rng(5)
    whole = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789+/"), 60_000))
    cut = spark.createDataFrame([(0, whole), (1, "x" + whole)], "i long, t string").select("i", F.explode(exact_dedup.chunks(F.col("t"))).alias("c"))
    have = defaultdict(set)
    for r in cut.collect():
        have[r.i].add(r.c)
    assert len(have[0] & have[1]) > 0.9 * len(have[0])


def repeated_ids(spark):
    """Ids that stand for two texts or vectors each."""
    texts = ["one two three four five six seven", "red green blue black white grey pink", "red green blue black white grey pink"]
    return spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[2]), (3, texts[0])], "doc_id long, text string")


def test_near_documents_of_repeated_ids(spark):
    got = ngram_join.near_documents(repeated_ids(spark), Workspace(spark, "t")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def shingles(x, n=5):
    w = (x or "").encode().lower().split()
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, threshold=0.8):
    """{row index: (class, links)}"""
    sets = [shingles(x) if i is not None else set() for i, x in rows]
    at, both = defaultdict(list), Counter()
    for k, s in enumerate(sets):
        for g in s:
            at[g].append(k)
    for hit in at.values():
        both.update((a, b) for j, b in enumerate(hit) for a in hit[:j])
    links, parent = Counter(), list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for (a, b), n in both.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= threshold:
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(repr((i, least.get(find(k)), links[k])) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_near_documents(spark, request, which):
    df = request.getfixturevalue(which)
    got = ngram_join.near_documents(df, Workspace(spark, "t")).collect()
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert sorted(repr((r.doc_id, r.class_id, r.n_links)) for r in got) == brute(rows)


def variants(n, seed=3):
    """Near copies of one text, chained and crowded, more than a block holds."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in rng.integers(0, 200, i % 4):
            w[k] = f"v{rng.integers(0, 50)}"
        rows.append((i, " ".join(w)))
    return rows + [(n + i, " ".join(f"u{i}x{k}" for k in range(40))) for i in range(50)]


def test_crowded_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 32)
    monkeypatch.setattr(ngram_join, "NODE", 24)
    rows = variants(300)
    got = ngram_join.near_documents(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t")).collect()
    assert sorted(repr((r.doc_id, r.class_id, r.n_links)) for r in got) == brute(rows)


def test_crowds_of_equal_sketches_lose_no_link(spark, monkeypatch):
    """Long texts that differ in their last word: the nodes of a crowd have the same members."""
    monkeypatch.setattr(ngram_join, "BLOCK", 32)
    monkeypatch.setattr(ngram_join, "NODE", 24)
    groups, size = 12, 40
    rows = [(g * size + i, " ".join([*(f"g{g}w{k}" for k in range(1500)), f"id{i}"])) for g in range(groups) for i in range(size)]
    got = ngram_join.near_documents(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == [(i, i // size * size, size - 1) for i in range(groups * size)]


def test_pairs_at_the_threshold_in_crowded_nodes(spark, monkeypatch):
    """With every node crowded, pairs of exactly 0.8 have to follow common paths to the last depth."""
    monkeypatch.setattr(ngram_join, "NODE", 1)
    pairs = 2000
    # 80 common 5-grams of 100: 84 common words, 10 of each one's own
    rows = [(2 * p + k, " ".join([*(f"p{p}w{j}" for j in range(84)), *(f"p{p}x{k}y{j}" for j in range(10))])) for p in range(pairs) for k in (0, 1)]
    got = ngram_join.near_documents(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t")).collect()
    assert sum(r.n_links == 0 for r in got) / 2 <= 0.002 * pairs


@pytest.mark.parametrize("pairs", [0, ngram_join.PAIRS])
def test_few_pairs_are_not_split_again(spark, monkeypatch, pairs):
    """Nodes that hold few pairs together are compared whole: no further levels, and the same links."""
    monkeypatch.setattr(ngram_join, "NODE", 8)
    monkeypatch.setattr(ngram_join, "PAIRS", pairs)
    written, write = [], Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda ws, df, name, **options: written.append(name) or write(ws, df, name, **options))
    rows = [(2 * p + k, " ".join([*(f"p{p}w{j}" for j in range(30)), *(["same words at every end"] * 3), f"x{k}"])) for p in range(150) for k in (0, 1)]
    got = ngram_join.near_documents(spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t")).collect()
    assert sorted(repr((r.doc_id, r.class_id, r.n_links)) for r in got) == brute(rows)
    assert "state-2" in written and ("level-3" in written) == (pairs == 0)


def test_one_of_each(spark, docs):
    got = ngram_join.one_of_each(docs, Workspace(spark, "t"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got.columns == docs.columns and got.count() == len({eval(x)[1] for x in brute(rows)})


def test_jaccard_is_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 30).astype(np.uint64)) for _ in range(20)]
    got = ngram_join.jaccard(sets[:7], sets[7:])
    want = [[len(set(a) & set(b)) / len(set(a) | set(b)) for b in map(np.ndarray.tolist, sets[7:])] for a in map(np.ndarray.tolist, sets[:7])]
    assert np.allclose(got, want, atol=0)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(300, 299), (7, 7)]
    got = {r.id: r.component for r in components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)} | {299: 299, 300: 299}
    assert components(Workspace(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, threshold=0.95):
    ok = [i for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    good = {k: np.array(v, float) for k, (i, v) in enumerate(rows) if i in ok and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    links, parent = Counter(), list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(repr((i, links[k], least.get(find(k)), i is not None and i == least[find(k)])) for k, (i, _) in enumerate(rows))


def cloud(n=240, seed=2):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((12, 16))
    return [(i, (centers[i % 12] + rng.standard_normal(16) * 0.18).astype(np.float32).tolist()) for i in range(n)]


#: One id with two vectors, and a neighbour of each.
TWICE = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [3.0, 0.0]), (4, [0.01, 1.0])]
ODD_VECTORS = [
    (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.1]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [float("inf"), 1.0]),
    (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (2, [1.0, 0.0]), (11, [-1.0, 0.0]), (12, [3e38, 3e37]),
]


@pytest.mark.parametrize("rows", [cloud(), ODD_VECTORS, TWICE, []], ids=["cloud", "odd", "twice", "empty"])
def test_near_vectors(spark, rows):
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], "vec_id long, embedding array<float>, rep string, component string")
    got = embedding_dedup.near_vectors(df, Workspace(spark, "t")).collect()
    assert sorted(map(repr, map(tuple, got))) == brute_vectors(rows)


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rows = cloud(400)
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), Workspace(spark, "t")).collect()
    assert sorted(map(repr, map(tuple, got))) == brute_vectors(rows)
