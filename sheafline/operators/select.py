"""Choosing rule documents for requests: which names, in which order, and their contents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import catalog
from ..session import shared_dir

_NONE = "array<string>"
#: Bytes of what is made for lists that go to all rows as a table; beyond, both sides are shuffled.
SENT = 64 << 20


def _names(*parts: Column) -> Column:
    return F.concat(*[F.coalesce(p, F.array().cast(_NONE)) for p in parts])


def one(c: Column) -> Column:
    """An array of the value, or of nothing if it is null."""
    return F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast(_NONE))


def universal_without(frameworks: Column) -> Column:
    """Universal rules that aren't asked for as frameworks, in order."""
    asked = F.transform(F.coalesce(frameworks, F.array().cast(_NONE)), F.lower)
    return F.filter(F.array(*map(F.lit, catalog.UNIVERSAL)), lambda r: ~F.array_contains(asked, r))


def folder_rule_names(language: Column, frameworks: Column, most: int = 3) -> Column:
    """The language's rule, its additional ones, and the first frameworks'. An empty language counts as none."""
    language = F.nullif(language, F.lit(""))
    first = F.transform(F.slice(F.coalesce(frameworks, F.array().cast(_NONE)), 1, most), F.lower)
    extra = F.when(language.isNotNull(), catalog.additional_rules(language))
    return _names(one(catalog.rule_name(language)), extra, first)


def monorepo_rule_names(languages: Column) -> Column:
    """Universal rules for a root, then one for each distinct language."""
    keys = F.array_distinct(F.transform(F.coalesce(languages, F.array().cast(_NONE)), catalog.language_key))
    own = F.filter(F.transform(keys, catalog.rule_name), lambda x: x.isNotNull())
    return _names(F.array(*map(F.lit, catalog.MONOREPO_UNIVERSAL)), own)


def grams(c: Column, n: int) -> Column:
    """The distinct pieces of n characters."""
    cut = F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: c.substr(i, F.lit(n)))
    return F.when(F.length(c) >= n, F.array_distinct(cut)).otherwise(F.array().cast(_NONE))


def first_holding(names: DataFrame, entries: DataFrame) -> DataFrame:
    """(rule_name, entry, found): for each of ``names(rule_name)``, the first of ``entries(entry, found)`` whose name contains it.

    An index from pieces of up to three characters to entries stands in for comparing all
    with all. A name meets the entries that hold its rarest piece, and only these are
    compared whole; a name of one or two characters is its own piece. The empty name is in
    every entry. Names without an entry have no row; nulls neither ask nor answer. Names
    should be distinct. Equal entries are one in the index, with the smaller ``found``, null
    first. What is exploded is far larger than the file that Spark judges it by, so nothing
    here is broadcast: all meets by piece, or by entry.
    """
    names = names.where("rule_name IS NOT NULL").select("rule_name")
    entries = entries.where("entry IS NOT NULL").groupBy("entry").agg(F.min(F.struct("found")).alias("first"))
    size = F.length("rule_name")
    own = F.when(size >= 3, grams(F.col("rule_name"), 3)).otherwise(F.array("rule_name"))
    asked = names.where("rule_name <> ''").select("rule_name", F.explode(own).alias("gram"))
    held = F.concat(*[grams(F.col("entry"), n) for n in (1, 2, 3)])
    # only pieces that are asked for stay in the index
    index = entries.select("entry", F.explode(held).alias("gram")).hint("merge").join(asked.select("gram").distinct(), "gram", "left_semi")
    frequent = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.hint("merge").join(frequent, "gram", "left").groupBy("rule_name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    rarest = rarest.where("r.n > 0").select("rule_name", F.col("r.gram").alias("gram"))
    near = rarest.hint("merge").join(index, "gram").where(F.contains("entry", "rule_name"))
    best = near.groupBy("rule_name").agg(F.min("entry").alias("entry")).hint("merge").join(entries, "entry")
    best = best.select("rule_name", "entry", F.col("first.found").alias("found"))
    # the empty name, if it is asked for: one aggregate over both sides
    either = entries.select(F.struct("entry", "first").alias("b"), F.lit(False).alias("asked"))
    either = either.unionByName(names.where("rule_name = ''").select(F.lit(None).cast(dict(either.dtypes)["b"]).alias("b"), F.lit(True).alias("asked")))
    empty = either.agg(F.min("b").alias("b"), F.max("asked").alias("asked")).where("asked AND b IS NOT NULL")
    return best.unionByName(empty.select(F.lit("").alias("rule_name"), "b.entry", F.col("b.first.found").alias("found")))


def lookup_rules(names: DataFrame, corpus: DataFrame) -> DataFrame:
    """(rule_name, content) for each distinct name of ``names(rule_name)``.

    ``corpus`` has (rule_name, tier, content). A tier 1 document of that very name holds, even
    if its content is null. Otherwise the first tier 2 entry, by name, whose name contains it
    is taken, and no later one if that has no content. Names are compared as text. Nothing
    found gives null.
    """
    names = names.select("rule_name").where("rule_name IS NOT NULL").distinct()
    exact = corpus.where("tier = 1").select("rule_name", "content").dropDuplicates(["rule_name"]).withColumn("exact", F.lit(True))
    first = names.join(exact, "rule_name", "left")
    second = corpus.where("tier = 2").select(F.col("rule_name").alias("entry"), F.col("content").alias("found"))
    best = first_holding(first.where("exact IS NULL"), second).drop("entry")
    return first.join(best, "rule_name", "left").select("rule_name", F.when(F.col("exact"), F.col("content")).otherwise(F.col("found")).alias("content"))


def filled_rules(names: DataFrame, corpus: DataFrame, **made: Column) -> DataFrame:
    """(rule_name, content, ``made``) of the distinct names found with a content; what is made of it is made once a rule."""
    found = lookup_rules(names, corpus).where("content <> ''")
    return found.select("rule_name", "content", *[c.alias(k) for k, c in made.items()])


def dealt(df: DataFrame) -> DataFrame:
    """The rows in tasks of equal size: what is then made in them is far larger than the few blocks of a file that they come from."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def per_list(df: DataFrame, by: list[str], made: Callable[[DataFrame, str], DataFrame], most: int = SENT) -> DataFrame:
    """``df`` with ``made``, which depends on the columns ``by`` alone; null where there is none.

    ``made(lists, key)`` gives (key, made) for ``lists``, the different values of ``by`` with
    all of them as one ``key``. It is worked out once for each and kept in the checkpoint
    folder. Up to ``most`` bytes of it go to the rows; beyond, both sides are shuffled. Spark's
    own estimate would send the rows, which are only dealt evenly.
    """
    shared_dir(df.sparkSession)
    key = F.struct(*by)
    # a checkpoint before as well, or filters on what is made would be worked out for each row
    lists = df.select(*by).distinct().checkpoint()
    got = made(lists.withColumn("_list", key), "_list").select("_list", "made").checkpoint()
    size = got.agg(F.sum(F.octet_length(F.col("made").cast("string")))).first()[0] or 0
    return dealt(df).withColumn("_list", key).join(got.hint("broadcast" if size <= most else "merge"), "_list", "left").drop("_list")


def listed_contents(lists: DataFrame, corpus: DataFrame, key: str, **made: Column) -> DataFrame:
    """(key, ord, rule_name, content, ``made``) of ``lists(key, names)``; missing and empty documents are dropped."""
    listed = lists.select(key, F.posexplode("names").alias("ord", "rule_name"))
    return listed.hint("merge").join(filled_rules(listed, corpus, **made), "rule_name").select(key, "ord", "rule_name", "content", *made)


def with_contents(wanted: DataFrame, corpus: DataFrame, key: str = "request_id", **made: Column) -> DataFrame:
    """(key, ord, rule_name, content, ``made``) of ``wanted(key, names)``; missing and empty documents are dropped."""
    def gathered(lists: DataFrame, one: str) -> DataFrame:
        got = listed_contents(lists, corpus, one, **made)
        return got.groupBy(one).agg(F.array_sort(F.collect_list(F.struct("ord", "rule_name", "content", *made))).alias("made"))

    return per_list(wanted.select(key, "names"), ["names"], gathered).select(key, F.inline("made"))


def first_per_group(df: DataFrame, group: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def first_seen(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Each group's distinct values with where each was first seen; combined before the shuffle."""
    return df.groupBy(group, value).agg(F.min(order).alias(order))
