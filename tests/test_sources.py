import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sheafline.operators import detect
from sheafline.sources import listing, sinks


def project(top: Path, name: str) -> str:
    root = top / name
    for at, text in {
        "packages/api/requirements.txt": "fastapi\n", "packages/.hidden/go.mod": "", "packages/bad/package.json": None, "packages/bad/tsconfig.json": "{}",
        "web/package.json": '{"dependencies": {"react": "1"}}', "docs/readme.md": "x", ".git/Cargo.toml": "", "packages/both/Cargo.toml": "", "packages/both/go.mod": "",
    }.items():
        (root / at).parent.mkdir(parents=True, exist_ok=True)
        (root / at).write_bytes(b"\xff\xfe" if text is None else text.encode())
    return str(root)


def test_listing_of_many_roots(spark, tmp_path):
    roots = [project(tmp_path, f"r{i}") for i in range(5)] + [str(tmp_path / "absent")]
    got = listing.project_listing(spark, *roots)
    rows = {(os.path.basename(r.root), r.folder, r.name, r.content) for r in got.collect()}
    one = {
        ("packages/api", "requirements.txt", "fastapi\n"), ("packages/bad", "package.json", None), ("packages/bad", "tsconfig.json", None), ("packages/both", "Cargo.toml", None),
        ("packages/both", "go.mod", None), ("web", "package.json", '{"dependencies": {"react": "1"}}'),
    }
    assert rows == {(f"r{i}", *x) for i in range(5) for x in one}
    assert got.rdd.getNumPartitions() == 6 * len(roots)
    assert listing.project_listing(spark).count() == 0


def test_listing_takes_filters_over(spark, tmp_path):
    roots = [project(tmp_path, f"r{i}") for i in range(3)]
    some = listing.project_listing(spark, *roots).where(F.col("name").isin("go.mod", "package.json") & (F.col("root") == roots[1]) & (F.col("is_dir") == F.lit(False)))
    assert {(r.root, r.folder, r.name) for r in some.collect()} == {(roots[1], f, n) for f, n in (("packages/bad", "package.json"), ("packages/both", "go.mod"), ("web", "package.json"))}
    assert some.rdd.getNumPartitions() == 6
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = listing.ListingReader(roots, [])
    left = list(reader.pushFilters([EqualTo(("name",), "go.mod"), In(("name",), ("go.mod", "x")), GreaterThan(("name",), "a"), EqualTo(("is_dir",), False)]))
    assert [type(f).__name__ for f in left] == ["GreaterThan", "EqualTo"]
    assert {r[3] for p in reader.partitions() for r in reader.read(p)} == {"go.mod"}


def test_packages_of_listed_roots(spark, tmp_path):
    got = detect.discover_packages(listing.project_listing(spark, project(tmp_path, "a"), project(tmp_path, "b"))).collect()
    assert sorted((os.path.basename(r.root), r.folder_path, r.language, r.frameworks, bool(r.warning)) for r in got) == sorted(
        (root, *x) for root in "ab" for x in (("packages/api", "python", ["fastapi"], False), ("packages/bad", "javascript", [], True), ("packages/both", "rust", [], False))
    )


def artifacts(spark, rows, parts=3):
    return spark.createDataFrame(rows, "path string, content string").repartition(parts)


def test_artifacts_are_committed(spark, tmp_path):
    rows = [(f"d{i % 4}/f{i}.md", f"text {i}\r\n") for i in range(40)] + [("null.md", None)]
    done = sinks.write_artifacts(artifacts(spark, rows), str(tmp_path))
    assert sorted(done) == sorted(p for p, _ in rows)
    assert {str(p.relative_to(tmp_path)): p.read_bytes().decode() for p in tmp_path.rglob("*") if p.is_file()} == {p: c or "" for p, c in rows}
    sinks.write_artifacts(artifacts(spark, [("d0/f0.md", "new")]), str(tmp_path))
    assert (tmp_path / "d0/f0.md").read_text() == "new" and not list(tmp_path.glob(".staging*"))
    assert sinks.write_artifacts(artifacts(spark, []), str(tmp_path)) == []


@pytest.mark.parametrize("path", ["../out.md", "/etc/out.md", "a/../../out.md", "."])
def test_nothing_is_written_outside_or_by_halves(spark, tmp_path, path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "kept.md").write_text("old")
    with pytest.raises(Exception, match="isn't below"):
        sinks.write_artifacts(artifacts(spark, [("kept.md", "new"), *((f"f{i}.md", "x") for i in range(20)), (path, "x")]), str(root))
    assert [p.name for p in root.iterdir()] == ["kept.md"] and (root / "kept.md").read_text() == "old"
    assert [p.name for p in tmp_path.iterdir()] == ["root"]


def test_a_retried_task_and_a_repeated_commit(tmp_path):
    """A first attempt's files are never moved; a commit that is repeated changes nothing."""
    from pyspark.sql import Row

    writer = sinks.ArtifactWriter(str(tmp_path), "job")
    rows = [Row(path="a.md", content="one"), Row(path="b.md", content="two")]

    def breaks():
        yield Row(path="a.md", content="half")
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(breaks())
    message = writer.write(iter(rows))
    writer.commit([message, None])
    writer.commit([message])
    assert (tmp_path / "a.md").read_text() == "one" and (tmp_path / "b.md").read_text() == "two"
    writer.abort([message])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.md", "b.md"]


