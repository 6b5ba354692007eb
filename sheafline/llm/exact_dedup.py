"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so, each chunk gets an identifier that is
verified against the chunk's characters, and texts are compared as ordered lists of
identifiers. A chunk crosses the network once per map task that holds it; whole
documents never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, free_name, matched, text_mark, without

#: 512 to 4096 characters, ending at the first place after 512 where the content allows: prose, code and encoded bytes all have some.
CHUNK = r"(?s).{512,4096}?(?:d |\n|[。、，；;=}]|[0-9][a-z])|.{1,4096}"
#: Non-ASCII characters that lower() changes.
CAPITAL = r"[[^\x00-\x7F]&&[\p{IsUppercase}\p{Lt}]]"
OTHER = r"[\x00-\x7F[^\p{IsUppercase}\p{Lt}]]"


def normal(text: Column) -> Column:
    """Lower-case A-Z only; null is empty.

    ``lower`` changes non-ASCII text only at non-ASCII capitals, so a text is taken apart
    at those and lowered between them.
    """
    whole = F.coalesce(text, F.lit(""))
    parts = F.regexp_extract_all(whole, F.lit(f"{OTHER}+|{CAPITAL}+"), F.lit(0))
    lowered = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^{CAPITAL}"), p).otherwise(F.lower(p))), "")
    only_ascii = F.octet_length(whole) == F.char_length(whole)
    return F.when(only_ascii, F.lower(whole)).otherwise(lowered)


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def exact_rows(docs: DataFrame, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", ident=F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: doc_id, mark (of the text), keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal to each other. The largest id of a group stays; rows
    that repeat an id and a text are equal rows, and all of them carry ``kept`` if their
    id stays. A null id is never kept unless its whole group has null ids (then keep_id is
    null and kept is false). An empty table gives an empty result. ``ident`` is the
    chunk hash: where two different chunks share one, documents that hold either are
    compared by their whole text instead.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_mark(F.col(text_col)).alias("mark"), normal(F.col(text_col)).alias("norm"))
    cut = texts.select("doc_id", "mark", "norm", chunks(F.col("norm")).alias("chunks"))

    def identifier(c: Column) -> Column:
        return F.struct(ident(c).alias("h"), F.char_length(c).alias("n"))

    # explode_outer: for explode the optimizer adds filters that cut every text again
    each = cut.select(F.explode_outer("chunks").alias("chunk")).where("chunk is not null")
    seen = each.select(identifier(F.col("chunk")).alias("id"), "chunk").distinct()
    clashes = ws.write(seen.groupBy("id").agg(F.count("*").alias("texts")).where("texts > 1").select("id"), "clashes")

    made = cut.select("doc_id", "mark", F.transform("chunks", identifier).alias("recipe"), F.sha2("norm", 256).alias("text_sha256"))
    recipes = ws.write(made, "recipes")
    if not clashes.isEmpty():
        bad = recipes.select("recipe", F.explode("recipe").alias("id")).join(clashes, "id", "left_semi").select("recipe").distinct()
        bad = ws.write(bad, "clashing")
        clean = recipes.join(bad, "recipe", "left_anti").withColumn("whole", F.lit(""))
        full = cut.select(F.transform("chunks", identifier).alias("recipe"), "doc_id", "mark", F.sha2("norm", 256).alias("text_sha256"), F.col("norm").alias("whole"))
        recipes = ws.write(clean.unionByName(full.join(bad, "recipe", "left_semi")), "verified")
        key = ["recipe", "whole"]
    else:
        key = ["recipe"]
    # written, so that the join below reads both sides by key and a group of very many copies can be split
    groups = ws.write(recipes.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return recipes.join(groups, key).select(
        "doc_id", "mark", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256"
    )


def exact_groups(docs: DataFrame, ws: Workspace, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: as ``exact_rows``, without the mark."""
    return exact_rows(docs, ws, **options).drop("mark")


def drop_copies(docs: DataFrame, ws: Workspace) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows without an id stay.

    Rows that repeat an id are told apart by their text; of rows that repeat both, one stays.
    """
    inner = ws.inner("groups")
    rows = ws.write(exact_rows(docs, inner).where("doc_id IS NOT NULL").select("doc_id", "mark", "kept"), "rows")
    inner.clear()
    kept = without(docs, ws, rows.where("not kept"))
    again = ws.write(rows.where("kept").groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "mark"), "repeated")
    if again.isEmpty():
        return kept
    mark = free_name(docs.columns, "_mark")
    several = matched(kept, ws, again, "left_semi", "several").withColumn(mark, text_mark(F.col("text"))).dropDuplicates(["doc_id", mark]).drop(mark)
    return matched(kept, ws, again, "left_anti", "single").unionByName(several)


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""
