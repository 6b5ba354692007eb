import math
import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from sheafline.llm import mixing
from sheafline.llm.common import Workspace

COLUMNS = "doc_id", "size", "source_size", "target", "taken"


def targets(sizes, share=1.5, most=2.0, weights=(3.0, 1.0, 2.0)):
    """By resharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    out, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def taken_by_hand(texts):
    """(doc_id, source, size, taken) of rows (doc_id, source, text): every word taken is counted one by one.

    A source's line is its rows in the order of lane, hash, id and size; the mix takes the line's words from its
    beginning, and again from there, until it has as many as the target.
    """
    lines = defaultdict(list)
    for i, s, t in texts:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        h = xxhash.xxh64_intdigest(struct.pack("<i", mixing.SEED), 42)
        for x in (i, size):
            h = h if x is None else xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        lines[s].append(((h >> 40) % mixing.LANES, signed(h), i is not None, i or 0, size, i))
    want = targets({s: sum(r[4] for r in rows) for s, rows in lines.items()})
    out = []
    for s, rows in lines.items():
        rows.sort()
        owner = [k for k, r in enumerate(rows) for _ in range(r[4])]
        taken = Counter(owner[w % len(owner)] for w in range(math.floor(want[s] + 0.5))) if owner else Counter()
        out += [(r[5], s, r[4], taken[k]) for k, r in enumerate(rows)]
    return out


@pytest.mark.parametrize("which", ["docs", "odd", "sf"])
def test_taken_of_each_document(spark, sf, request, which):
    df = spark.read.parquet(f"{sf}/documents.parquet") if which == "sf" else request.getfixturevalue(which)
    want = taken_by_hand([(r.doc_id, r.source, r.text) for r in df.select("doc_id", "source", "text").collect()])
    for block in (None, 7, 1000):
        got = mixing.mix(df, Workspace(spark, "t"), block=block)[0].collect()
        assert Counter((r.doc_id, r.source, r["size"], r.taken) for r in got) == Counter(want)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mix(spark, request, which):
    df = request.getfixturevalue(which)
    rows = mixing.mix(df, Workspace(spark, "t"))[0].collect()
    texts = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in df.collect()]
    assert sorted(repr((r.doc_id, r.source, r["size"])) for r in rows) == sorted(map(repr, texts))
    sizes, taken = Counter(), Counter()
    for _, s, n in texts:
        sizes[s] += n
    want = targets(sizes)
    for r in rows:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r["size"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(df, Workspace(spark, "t"))[0].collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_targets_for_many_shapes(spark):
    for k in range(6):
        sizes = {None if i == 3 else f"s{i:02d}": (i * 37 * (k + 1)) % 101 + (500 if i == k else 0) for i in range(4 + k)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert got == pytest.approx(targets(sizes))


def test_slots_are_a_low_discrepancy_schedule(spark, docs):
    _, slots = mixing.mix(docs, Workspace(spark, "t"))
    rows = sorted(slots.collect(), key=lambda r: r.slot)
    ranks = defaultdict(list)
    for r in rows:
        ranks[r.i].append(r["rank"])
    assert all(x == list(range(len(x))) for x in ranks.values())
    total = Counter(r.i for r in rows)
    seen = Counter()
    for n, r in enumerate(rows[: len(rows) * 9 // 10], 1):
        seen[r.i] += 1
        assert all(abs(seen[i] - n * total[i] / len(rows)) < 12 for i in total)


def test_hot_source_and_running_sums(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"), F.when(F.col("id") % 3 == 0, "x").otherwise("hot").alias("source"))
    rows = mixing.mix(df, Workspace(spark, "t"))[0].collect()
    places = sorted(r.position for r in rows if r.source == "hot")
    assert places == list(range(0, 10000, 5))


def test_repeats_and_empty(spark, docs, empty):
    out = mixing.repeat_documents(docs, Workspace(spark, "t"))
    assert out.columns == docs.columns and out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert mixing.mix(empty, Workspace(spark, "t"))[0].count() == 0 and mixing.repeat_documents(empty, Workspace(spark, "t")).count() == 0


def test_repeats_of_the_odd_table(spark, odd):
    """Any column name, rows that repeat an id, and rows without one."""
    odd = odd.withColumns({c: F.lit("z") for c in ("_times", "_k", "_id", "_size", "_copy")})
    got = mixing.repeat_documents(odd, Workspace(spark, "t"))
    assert got.columns == odd.columns
    taken = {(r.doc_id, r["size"]) for r in mixing.mix(odd, Workspace(spark, "t"))[0].collect() if r.taken}
    assert {(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in got.collect()} >= taken


def test_slots_do_not_follow_the_smallest_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 64)
    rows = [(i, " ".join(["w"] * 500), "large") for i in range(100)] + [(1000, "a b c d e f g h", "small")]
    taken, slots = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), Workspace(spark, "t"))
    assert slots.count() <= 64 + 4
    got = {r.source: (r.n, r.target) for r in taken.groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("target")).collect()}
    assert all(abs(n - target) <= 1 for n, target in got.values())


def test_rows_without_an_id_are_repeated_too(spark):
    rows = [(i, "a b c d", "x") for i in range(20)] + [(None, "no id here", "x"), (None, "", "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.repeat_documents(df, Workspace(spark, "t")).collect()
    assert {r.text for r in got if r.doc_id is None} == {"no id here"} and {r.doc_id for r in got} == {None, *range(20)}
