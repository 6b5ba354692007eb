from pyspark.sql import functions as F

from sheafline import catalog, schema
from sheafline.operators import options, select
from sheafline.streaming.selection import select_many


def corpus(spark, rows):
    return spark.createDataFrame(rows, schema.CORPUS)


def test_lookup_tiers(spark):
    c = corpus(spark, [("python", 1, "one"), ("unread", 1, None), ("a-vue-x", 2, None), ("b-vue-y", 2, "late"), ("my-flask", 2, "flask"), ("unread-2", 2, "no")])
    names = spark.createDataFrame([(n,) for n in ("python", "unread", "vue", "flask", "absent", "python", "*")], "rule_name string")
    got = {r.rule_name: r.content for r in select.lookup_rules(names, c).collect()}
    assert got == {"python": "one", "unread": None, "vue": None, "flask": "flask", "absent": None, "*": None}


def names(spark, column):
    return spark.range(1).select(column.alias("n")).first().n


def words(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


def test_rule_names(spark):
    assert names(spark, select.folder_rule_names(F.lit("TS"), words("React", "vue", "x", "y"))) == ["typescript", "codequality", "clean-code", "react", "vue", "x"]
    assert names(spark, select.folder_rule_names(F.lit("python"), words())) == ["python", "database", "codequality", "clean-code"]
    assert names(spark, select.folder_rule_names(F.lit(""), words("a"))) == ["a"]
    assert names(spark, select.monorepo_rule_names(words("ts", "typescript", "go", "rust"))) == ["codequality", "clean-code", "gitflow", "typescript", "rust"]
    assert names(spark, select.universal_without(words("Database"))) == ["codequality", "clean-code", "gitflow"]


def test_contents_drop_what_is_missing(spark):
    c = corpus(spark, [("a", 1, "A"), ("b", 1, ""), ("c", 1, "C")])
    wanted = spark.createDataFrame([("r", ["c", "b", "x", "a", "c"])], "request_id string, names array<string>")
    got = select.with_contents(wanted, c).orderBy("ord").collect()
    assert [(r.ord, r.rule_name) for r in got] == [(0, "c"), (3, "a"), (4, "c")]


def test_dimensions(spark):
    assert catalog.languages(spark).count() == 19
    pairs = catalog.language_frameworks(spark)
    assert pairs.count() == 71 and pairs.select("framework").distinct().count() == 43
    assert names(spark, catalog.available_frameworks(F.lit("ruby"))) == ["rails"]
    assert names(spark, catalog.available_frameworks(F.lit("cobol"))) == []
    assert [r.language for r in catalog.primary_languages(spark).orderBy("pos").collect()] == catalog.PRIMARY
    assert catalog.markers(spark).count() == 13 and catalog.providers(spark).count() == 3 and catalog.tools(spark).count() == 6
    assert catalog.package_dirs(spark).count() == 5 and catalog.npm_frameworks(spark).count() == 7 and catalog.universal_rules(spark).count() == 4


def test_options(spark):
    offered = words("alpha", "beta", "alphabet")
    def picked(s):
        return names(spark, options.pick_or_search(offered, F.lit(s)))
    assert [picked(s) for s in ("1", "3", "4", "0", "", "bet", "BETA", "alpha", "zz")] == ["alpha", "alphabet", None, None, "alpha", None, "beta", None, None]
    assert picked("habet") == "alphabet"
    assert names(spark, options.selected_summary(words("node-express", "b", "c", "d", "e", "f"))) == "Node Express, B, C, D, E ... (+1 more)"
    many = spark.range(40).select("id", F.concat(F.lit("Opt "), "id").alias("o"))
    assert [r.number for r in options.numbered(many, "id").orderBy("id").collect()] == list(range(1, 26))
    assert options.search(many, "o", "PT 3").count() == 11 and options.search(many, "o", "").count() == 40
    assert names(spark, options.more(F.lit(40))) == 15


def test_dialogue_is_a_fold(spark):
    offered = words("a", "b", "c")
    def run(defaults, *typed):
        s = names(spark, select_many(offered, words(*defaults), words(*typed)))
        return s.selected, s.remaining, s.done
    assert run([], "2", "1", "done", "1") == (["b", "a"], ["c"], True)
    assert run(["b", "z"], "done") == (["b"], ["a", "c"], True)
    assert run([], "done", "c") == (["c"], ["a", "b"], False)
    assert run(["b"], "clear", "a") == (["a"], ["b", "c"], False)
    assert run([], "nothing", "") == (["a"], ["b", "c"], False)


def test_validation(spark):
    known = catalog.tools(spark)
    asked = spark.createDataFrame([("warp",), ("vim",), ("cursor",)], "key string")
    assert [r.key for r in options.unknown(asked, known, "key").collect()] == ["vim"]
    assert [r.key for r in options.enabled(known, asked).collect()] == ["cursor", "warp"]
