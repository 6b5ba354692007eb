import json

from pyspark.sql import functions as F

from sheafline import schema
from sheafline.operators import detect

FOLDERS = {
    "setup": ({"setup.py": None}, "python", []),
    "both": ({"requirements.txt": "Flask-Cors", "package.json": "{}"}, "python", ["flask"]),
    "js": ({"package.json": json.dumps({"dependencies": {"react": "1", "next": "2"}})}, "javascript", ["nextjs", "react"]),
    "ts": ({"package.json": json.dumps({"devDependencies": {"typescript": "5", "svelte": "1", "sveltekit": "1"}})}, "typescript", ["svelte"]),
    "tsconfig": ({"package.json": "{}", "tsconfig.json": None}, "typescript", []),
    "bad": ({"package.json": "{bad", "tsconfig.json": None}, "javascript", []),
    "empty": ({"package.json": ""}, "javascript", []),
    "array": ({"package.json": "[1]"}, "javascript", []),
    "nulls": ({"package.json": '{"dependencies": null, "devDependencies": {"vue": {"version": 1}}}'}, "javascript", ["vue"]),
    "rust": ({"Cargo.toml": None, "go.mod": None}, "rust", []),
    "java": ({"build.gradle.kts": None, "Makefile": None}, "java", []),
    "cpp": ({"Makefile": None}, "cpp", []),
    "none": ({"README": None}, None, []),
}


def listing(spark, folders, root="r", parent="apps"):
    rows = [(root, parent, f"{parent}/{f}" if parent else f, n, False, c) for f, (files, *_) in folders.items() for n, c in files.items()]
    return spark.createDataFrame(rows, schema.LISTING)


def test_folder_technology(spark):
    got = {r.folder.split("/")[1]: r for r in detect.folder_technology(listing(spark, FOLDERS)).collect()}
    assert {k: (r.language, r.frameworks) for k, r in got.items()} == {k: (lang, fws) for k, (_, lang, fws) in FOLDERS.items()}
    assert {k for k, r in got.items() if r.warning} == {"bad", "empty"}


def test_packages_fall_back_to_the_roots_folders_per_root(spark):
    a = listing(spark, {"x": ({"go.mod": None}, 0, 0), ".hid": ({"go.mod": None}, 0, 0)}, "a")
    a = a.union(listing(spark, {"direct": ({"go.mod": None}, 0, 0)}, "a", ""))
    b = listing(spark, {"direct": ({"go.mod": None}, 0, 0), "node_modules": ({"go.mod": None}, 0, 0), ".d": ({"go.mod": None}, 0, 0)}, "b", "")
    b = b.union(listing(spark, {"nothing": ({"README": None}, 0, 0)}, "b"))
    got = detect.discover_packages(a.union(b)).select("root", "folder_path").collect()
    assert sorted(map(tuple, got)) == [("a", "apps/x"), ("b", "direct")]


def test_classification_is_one_shuffle_without_python(spark):
    plan = detect.folder_technology(listing(spark, FOLDERS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
    assert detect.folder_technology(spark.createDataFrame([], schema.LISTING)).count() == 0


def test_dependencies_of_odd_parts(spark):
    files = ['{"dependencies": {"a": 1, "b": {"x": null}}, "devDependencies": {"a": 2, "": 3}}', '{"dependencies": [{"a": 1}], "devDependencies": "b"}', "[1]", "null", "3", "{bad", "", None, '{"a": 1, "a": 2}']
    rows = spark.createDataFrame([("r", "", str(i), f) for i, f in enumerate(files)], "root string, parent string, folder string, package string")
    got = {}
    for r in detect.dependency_rows(rows, "package").collect():
        got.setdefault((int(r.folder), r.malformed), set()).add(r.dep)
    none = {None}
    assert got == {(0, False): {"a", "b", ""}, (1, False): none, (2, False): none, (3, False): none, (4, False): none, (5, True): none, (6, True): none, (7, True): none, (8, True): none}
    keys = {int(r.folder): r.k for r in rows.select("folder", detect.dependency_keys(F.col("package")).alias("k")).collect()}
    assert {i: sorted(k) for i, k in keys.items()} == {0: ["", "a", "b"]} | {i: [] for i in range(1, 9)}


def test_frameworks_by_a_table_of_dependencies(spark):
    table = spark.range(5000).select(F.col("id").cast("int").alias("pos"), F.concat(F.lit("dep"), F.col("id") % 2500).alias("dep"), F.concat(F.lit("fw"), F.col("id") % 7).alias("framework"))
    files = {str(i): ({"package.json": json.dumps({"dependencies": {f"dep{i}": "1", "other": "2"}, "devDependencies": {f"dep{i + 1}": "1"}})}, 0, 0) for i in range(40)}
    expected = {}
    for i in range(40):
        hits = sorted(p for p in range(5000) if p % 2500 in (i, i + 1))
        expected[str(i)] = list(dict.fromkeys(f"fw{p % 7}" for p in hits))
    for size in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        try:
            got = {r.folder.split("/")[1]: r.frameworks for r in detect.folder_technology(listing(spark, files), table).collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert got == expected
