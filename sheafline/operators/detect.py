"""Classifying folders by marker files and finding their frameworks.

One aggregation per folder gathers everything that decides; listings of any number of
roots go through together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog
from ..functions.text import keyword_hits

PARTS = ("$.dependencies", "$.devDependencies")
FOLDER = ("root", "parent", "folder")


def dependency_keys(content: Column) -> Column:
    """Keys of both dependency objects of a package file; a missing, null or non-object part is empty."""
    parsed, none = F.try_parse_json(content), F.array().cast("array<string>")
    return F.array_union(*[F.coalesce(F.map_keys(F.try_variant_get(parsed, p, "map<string,variant>")), none) for p in PARTS])


def dependency_rows(files: DataFrame, content: str) -> DataFrame:
    """``files`` with ``dep``, a row per dependency of the package file in ``content``, and ``malformed``.

    The text is parsed once. A file without dependencies keeps rows whose ``dep`` is null, as a missing,
    null or non-object part has none. What isn't JSON, or repeats a key within an object, is malformed. Rows of
    a file stay where it is: there is no shuffle.
    """
    parsed = files.withColumn("_parsed", F.try_parse_json(content))
    parts = parsed.withColumn("malformed", F.col("_parsed").isNull()).withColumn("_part", F.explode(F.array(*[F.try_variant_get("_parsed", p, "variant") for p in PARTS])))
    rows = parts.lateralJoin(files.sparkSession.tvf.variant_explode_outer(F.col("_part").outer()))
    return rows.withColumnRenamed("key", "dep").drop("_parsed", "_part", "pos", "value")


def dependency_frameworks(files: DataFrame, content: str, known: DataFrame | None = None) -> DataFrame:
    """``files`` (a row per folder) with ``malformed``, ``typed`` and ``by_dependency``, the frameworks of its dependencies.

    ``known(pos, dep, framework)`` is the table of dependencies, of any size; frameworks come in its order, each once.
    Spark chooses the join by the table's size; with a broadcast, rows aren't shuffled at all if ``files``
    is partitioned by folder.
    """
    known = F.broadcast(catalog.npm_frameworks(files.sparkSession)) if known is None else known
    rows = dependency_rows(files, content).join(known.select("dep", F.struct("pos", "framework").alias("hit")), "dep", "left")
    others = [F.any_value(c).alias(c) for c in files.columns if c not in FOLDER]
    hits = F.transform(F.array_sort(F.collect_set("hit")), lambda x: x.framework)
    return rows.groupBy(*FOLDER).agg(
        *others, F.any_value("malformed").alias("malformed"), F.coalesce(F.bool_or(F.col("dep") == "typescript"), F.lit(False)).alias("typed"), F.array_distinct(hits).alias("by_dependency")
    )


def folder_technology(listing: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(root, parent, folder, language, frameworks, warning) per folder; language is null if nothing marks it.

    ``listing`` has a row per file, with the content of package.json, requirements.txt
    and pyproject.toml. ``known`` is as in ``dependency_frameworks``.
    """
    def has(*names: str) -> Column:
        return F.coalesce(F.bool_or(F.col("name").isin(*names)), F.lit(False))

    def text(name: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.coalesce("content", F.lit(""))))

    found = listing.groupBy(*FOLDER).agg(
        *[has(*names).alias(f"is_{lang}") for lang, names in catalog.MARKERS.items()],
        has("tsconfig.json").alias("tsconfig"),
        text("package.json").alias("package"), text("requirements.txt").alias("requirements"), text("pyproject.toml").alias("pyproject"),
    )
    found = dependency_frameworks(found, "package", known)
    bad = F.col("malformed")
    script = F.when(bad, "javascript").when(F.col("tsconfig") | F.col("typed"), "typescript").otherwise("javascript")
    chain = [F.when(F.col(f"is_{lang}"), script if lang == "javascript" else F.lit(lang)) for lang in catalog.MARKERS]
    none = F.array().cast("array<string>")
    language = F.coalesce(*chain)
    by_keyword = keyword_hits(F.concat_ws("\n", "requirements", "pyproject"), catalog.PYTHON_KEYWORDS)
    frameworks = (
        F.when(F.col("language") == "python", by_keyword)
        .when(F.col("language").isin("javascript", "typescript"), F.col("by_dependency"))
        .otherwise(none)
    )
    warning = F.when(F.col("language").isin("javascript", "typescript") & bad, "package.json could not be parsed")
    return found.withColumn("language", language).select(*FOLDER, "language", frameworks.alias("frameworks"), warning.alias("warning"))


def discover_packages(listing: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Packages of each root, in order: classified folders in the package directories, or else the root's own folders.

    ``parent`` is the package directory's name, or '' for a folder directly below the root.
    """
    name = F.element_at(F.split("folder", "/"), -1)
    classified = folder_technology(listing, known).where("language IS NOT NULL").withColumn("folder_name", name)
    visible = classified.where(~F.startswith("folder_name", F.lit(".")))
    place = F.array_position(F.array(*map(F.lit, catalog.PACKAGE_DIRS)), F.col("parent")).cast("int")
    ranked = visible.withColumn("place", place).where((F.col("place") > 0) | (F.col("parent") == ""))
    ranked = ranked.where((F.col("place") > 0) | ~F.col("folder_name").isin(*catalog.SKIPPED_DIRS))
    standard = ranked.groupBy("root").agg(F.max(F.col("place") > 0).alias("standard"))
    kept = ranked.join(standard, "root").where((F.col("place") > 0) == F.col("standard"))
    return kept.select("root", "place", F.col("folder").alias("folder_path"), "folder_name", "language", "frameworks", "warning")
