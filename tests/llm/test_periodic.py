import functools
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.llm import periodic


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if w[q:] == w[: len(w) - q])


def brute_runs(w, least=6, times=4):
    """Every stretch, word by word."""
    found = []
    for q in range(1, len(w) // times + 1):
        need = max(least - q, (times - 1) * q)
        if b"\1" * need not in bytes(map(str.__eq__, w, w[q:])):
            continue
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q) and smallest_period(w[i : j + q]) == q:
                found.append((i, j - i + q, q))
            i = j + 1
    return sorted(found, key=lambda x: (x[0], x[2]))


def changed(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


@functools.cache
def report(doc_id, text):
    w = changed(doc_id, split(text))
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = (None,) * 4
    if runs:
        s, length, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (s, length, q, 1000 * length // q)
    return (doc_id, len(runs), *best, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def words(rng, n, kinds):
    """Words with repetitions, nested ones among them."""
    out = []
    while len(out) < n:
        piece = [rng.choice("abcdefghij"[:kinds]) for _ in range(rng.randrange(1, 6))]
        piece = piece * rng.choice([1, 1, 2, 5, 9])
        out += piece * rng.choice([1, 1, 4, 6]) + piece[: rng.randrange(len(piece) + 1)]
    return out


def coded(texts):
    flat = [x for t in texts for x in t]
    number = {x: i for i, x in enumerate(dict.fromkeys(flat))}
    return np.array([number[x] for x in flat], np.int64), np.cumsum([0, *map(len, texts)])


@pytest.mark.parametrize("heavy", [0.0, 0.05, 0.7, 1e9])
@pytest.mark.parametrize("kinds", [1, 2, 4, 10])
def test_runs_against_brute_force(heavy, kinds):
    rng = random.Random(kinds)
    texts = [words(rng, rng.choice([1, 5, 40, 200]), kinds) for _ in range(30)] + [[], ["x"] * 5, ["x"] * 6, ["x", "y"] * 4]
    assert periodic.find_runs(*coded(texts), heavy=heavy) == [brute_runs(t) for t in texts]


@pytest.mark.parametrize("heavy", [0.0, 0.3, 1e9])
def test_lag_counts(heavy):
    rng = random.Random(1)
    texts = [[rng.choice("aaab") for _ in range(n)] for n in (0, 1, 3, 4, 50, 700)]
    counts, base = periodic.lag_counts(*coded(texts), 4, heavy)
    for t, b in zip(texts, base):
        assert [counts[b + q] for q in range(1, len(t) // 4 + 1)] == [sum(x == y for x, y in zip(t, t[q:])) for q in range(1, len(t) // 4 + 1)]


def test_other_bounds():
    rng = random.Random(9)
    texts = [words(rng, 120, 3) for _ in range(10)]
    assert periodic.find_runs(*coded(texts), least=9, times=3) == [brute_runs(t, 9, 3) for t in texts]


def test_divisors():
    assert [periodic.divisors(q) for q in (1, 2, 7, 12, 36)] == [[], [1], [1], [6, 4], [18, 12]]


def test_long_text():
    """A period of 5000 words repeated five times among 60,000 others, and a short one."""
    rng = np.random.default_rng(3)
    w = rng.zipf(1.3, 60_000) % 20_000
    w[20_000:45_000] = np.tile(w[20_000:25_000], 5)
    w[50_000:50_040] = np.tile([-1, -2, -3, -4], 10)
    found = periodic.find_runs(w, np.array([0, len(w)]))[0]
    assert any(q == 5000 and length >= 25_000 for _, length, q in found)
    assert any(q == 4 and length == 40 and s == 50_000 for s, length, q in found)


@pytest.mark.parametrize("block", [1, 300, 1 << 22])
def test_query_columns(spark, docs, odd, block):
    mark = F.crc32(F.col("doc_id").cast("string"))
    for df in (docs, odd, odd.limit(0)):
        df = df.select("*", F.coalesce(mark, F.lit(1)).alias("mark_of_row"))
        found = periodic.periodic_runs(df, periodic.repeated(F.col("text"), F.col("mark_of_row")), block=block)
        got = sorted(repr(tuple(r)) for r in periodic.digests(found).collect())
        assert got == sorted(repr(report(r.doc_id, r.text)) for r in df.select("doc_id", "text").collect())


def test_registered_query(spark, sf, docs):
    got = periodic.op12_periodic_runs(spark, sf)
    assert got.columns == "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    got = sorted(repr(tuple(r)) for r in got.collect())
    assert got == sorted(repr(report(r.doc_id, r.text)) for r in docs.select("doc_id", "text").collect())
    assert any("None" not in x for x in got)


def test_collapsed_text(spark):
    rows = [(1, " a b\ta b a b a b a b c "), (2, None), (3, ""), (1, "x x x x x x y x x x x x x")]
    got = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), F.col("text")).collect()
    assert [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [
        (11, [(0, 10, 2)], "a b c"), (0, [], ""), (0, [], ""), (13, [(0, 6, 1), (7, 6, 1)], "x y x")
    ]
