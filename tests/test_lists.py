"""Requests of a table: what is made for them is made once for what they share, and they aren't sent anywhere."""

from pyspark.sql import functions as F

from sheafline import feature_queries, queries
from sheafline.functions import text as t
from sheafline.operators import select
from sheafline.plans import assemble


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_substring_index_is_not_broadcast(spark, sf):
    assert "BroadcastExchange" not in plan(feature_queries.q_substring_join(spark, sf))


def test_equal_entries_are_one(spark):
    entries = spark.createDataFrame([("banana", "b"), ("banana", None), ("bandana", "a"), ("ananas", "c"), ("ananas", "a")], "entry string, found string")
    names = spark.createDataFrame([("ban",), ("nas",), ("",)], "rule_name string")
    got = {r.rule_name: (r.entry, r.found) for r in select.first_holding(names, entries).collect()}
    assert got == {"ban": ("banana", None), "nas": ("ananas", "a"), "": ("ananas", "a")}


def test_documents_are_made_in_their_rows(spark, sf):
    for name in ("q_single_project", "q_prompt", "q_shared_files"):
        text = plan(queries.QUERIES[name](spark, sf))
        assert "collect_list" not in text and "rule_name" not in text, name


def test_lists_beyond_what_is_sent(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"l{i % 4}", None if i % 5 == 0 else ["x", None][: i % 3]) for i in range(40)], "id int, language string, frameworks array<string>")

    def made(lists, key):
        return lists.where("language IS NULL OR language <> 'l2'").select(key, F.to_json(F.struct("language", "frameworks")).alias("made"))

    want = {r.id: r.made for r in df.withColumn("made", F.when(F.col("language").isNull() | (F.col("language") != "l2"), F.to_json(F.struct("language", "frameworks")))).collect()}
    for most in (select.SENT, 0):
        got = select.per_list(df, ["language", "frameworks"], made, most)
        assert got.columns == ["id", "language", "frameworks", "made"]
        assert {r.id: r.made for r in got.collect()} == want and got.count() == 40


def test_line_counts(spark):
    ends = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " ", "é\n\n", "\n\r"]
    texts = [None, "", "a", *[x for e in ends for x in (e, f"a{e}b", f"a{e}", f"a\n{e}b\n")]]
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    assert [(r.s, r.n) for r in df.select("s", t.line_count(F.col("s")).alias("n")).collect()] == [(x, None if x is None else len(x.splitlines())) for x in texts]
    assert "contains" in plan(df.select(t.line_count(F.col("s")))).lower()


def test_framework_named_twice_is_one_file(spark):
    asked = spark.createDataFrame([("1", "d", False, "go", ["React", "react"], "o", None), ("2", "d", False, None, None, "o", None)], "request_id string, description string, is_monorepo boolean, primary_language string, frameworks array<string>, output_file string, project_root string")
    corpus = spark.createDataFrame([("react", 1, "R"), ("gitflow", 1, "G")], "rule_name string, tier int, content string")
    got = sorted((r.request_id, r.path) for r in assemble.shared_files(asked, corpus).collect())
    both = [".ai-rules/README.md", ".ai-rules/project-rules.md", ".ai-rules/universal-gitflow.md"]
    assert got == sorted([("1", ".ai-rules/framework-react.md"), *[(k, p) for k in "12" for p in both]])
