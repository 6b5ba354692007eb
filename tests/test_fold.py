import hashlib

import pytest
from pyspark.sql import functions as F

from sheafline.functions import text as t
from sheafline.operators import select
from sheafline.plans import assemble


def test_fold_in_order(spark):
    rows = [("a", 3, "z"), ("a", 1, "x"), ("a", 2, None), ("b", 1, None), ("c", 5, ""), ("a", 1, "w"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "k string, ord int, text string")
    for fold in (assemble.fold, assemble.fold_few):
        assert {r.k: r.content for r in fold(df, "k", "-").collect()} == {"a": "w-x-z", "c": "", None: "n"}
    assert assemble.fold(df.limit(0), "k").collect() == []


def test_fold_of_one_large_key(spark):
    """A million sections of one key, dealt in any order: no range holds many more than its share."""
    n, parts = 1_000_000, int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(n).select(F.lit("hot").alias("k"), ((F.col("id") * 7919) % n).alias("ord")).withColumn("text", F.concat(F.lit("s"), F.col("ord").cast("string")))
    rows = rows.unionByName(spark.range(50).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(0).cast("long").alias("ord"), F.lit("one").alias("text")))
    one = F.lit(1)
    held = assemble.pieces(rows.withColumn("text", one.cast("string")), "k", {"text": ""}).where("k = 'hot'").select(F.length("text").alias("n")).collect()
    assert len(held) >= parts - 1 and sum(r.n for r in held) == n and max(r.n for r in held) < 1.5 * n / (parts - 1)
    got = assemble.fold(rows, "k", "|").where("k = 'hot'").select(F.sha2("content", 256).alias("d")).first().d
    assert got == hashlib.sha256("|".join(f"s{i}" for i in range(n)).encode()).hexdigest()


def test_fold_many_orders_by_structs(spark):
    rows = [("r", (2, "a"), "C", "3"), ("r", (1, "b"), "B", "2"), ("r", (1, "a"), "A", "1")]
    df = spark.createDataFrame(rows, "k string, ord struct<p:int,n:string>, x string, y string")
    assert [tuple(r) for r in assemble.fold_many(df, "k", {"x": ", ", "y": ""}).collect()] == [("r", "A, B, C", "123")]


@pytest.mark.parametrize("most", [1, 2, 3, 5, 100])
def test_within_lines(spark, most):
    rows = [("a", i, x) for i, x in enumerate(["one\n", "two\nthree\n", "", "four", "\nfive\n", None, "six\n"])] + [("b", 0, "x\n" * 50), ("b", 1, "y")]
    df = spark.createDataFrame(rows, "k string, ord int, text string")
    whole = {r.k: r.content for r in assemble.fold(df, "k").collect()}
    cut = assemble.fold(assemble.within_lines(df, "k", most), "k").select("k", t.head_lines(F.col("content"), most).alias("c"))
    assert {r.k: r.c for r in cut.collect()} == {k: "\n".join(v.split("\n")[:most]) for k, v in whole.items()}
    assert assemble.within_lines(df, "k", most).where("k = 'b'").count() == (1 if most <= 50 else 2)


def rewritten(text, pattern):
    """Line by line, with a flag."""
    out, on = [], False
    for line in text.split("\n"):
        if "globs:" in line:
            on = True
        elif on and line.strip().startswith("-"):
            line, on = f'  - "{pattern}"', False
        out.append(line)
    return "\n".join(out)


GLOBS = [
    "", "globs:", "- a", "globs:\n- a\n- b", "---\nglobs:\n  - x\n  - y\n---\n- bullet\n", "globs: x\nno\n\n---\nbody", "- globs: a\n- b", "globs:\nglobs:\n- a\n- b",
    "x\n- a\nglobs:\n - em\n- b", "globs:\r\n- a\r\n- b\r\n", "a globs: - same line\n\x0b- vt\n", "globs:\n- a\nglobs:\n- b\nglobs:\n", "\n\n- a\nglobs:\n\n-", "globs:\n - globs:\n- c\n- d",
]


def test_rewrite_glob(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(GLOBS)] + [(99, None)], "i int, x string")
    got = {r.i: r.y for r in df.select("i", t.rewrite_glob(F.col("x"), F.lit("p/**")).alias("y")).collect()}
    assert got == {99: None} | {i: rewritten(x, "p/**") for i, x in enumerate(GLOBS)}


def test_rewrite_glob_is_linear(spark):
    """Texts of 100,000 lines, of which all or none matter."""
    for line in ("globs:", "- a", "plain", "globs:\n- a"):
        text = (line + "\n") * 100_000
        got = spark.createDataFrame([(text,)], "x string").select(F.sha2(t.rewrite_glob(F.col("x"), F.lit("p")), 256).alias("d")).first().d
        assert got == hashlib.sha256(rewritten(text, "p").encode()).hexdigest()


def test_title(spark):
    xs = ["", "a", "hello wORLD", "node-express", "it's 3d ñandú ÉCOLE", "x" * 3000 + " y", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    got = {r.i: r.y for r in df.select("i", t.title(F.col("x")).alias("y")).collect()}
    assert got == {i: None if x is None else x.title() for i, x in enumerate(xs)}


NAMES = ["", "a", "an", "ana", "banana", "zz", "xyzzy", "nan", "é", "日本", "%", "a_b", "BAN", None]
ENTRIES = ["banana", "ananas", "bandana", "", "a%b", "a_b", "日本語", "café é", "xyzz y", None, "banana"]


def test_first_holding(spark):
    names = spark.createDataFrame([(x,) for x in NAMES], "rule_name string")
    entries = spark.createDataFrame([(x, None if i % 3 == 0 else f"f{i}") for i, x in enumerate(ENTRIES)], "entry string, found string")
    rows = [(x, None if i % 3 == 0 else f"f{i}") for i, x in enumerate(ENTRIES) if x is not None]
    want = {}
    for n in NAMES:
        hits = sorted((e, f is not None, f or "") for e, f in rows if n is not None and n in e)
        if hits:
            want[n] = (hits[0][0], hits[0][2] if hits[0][1] else None)
    got = select.first_holding(names, entries)
    assert {r.rule_name: (r.entry, r.found) for r in got.collect()} == want
    assert select.first_holding(names, entries.limit(0)).collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
