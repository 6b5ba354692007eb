"""Which of a table's keywords occur in each text: one automaton, one pass over a text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Characters of keywords that go into one automaton; a larger table is taken in several passes.
BOUND = 4 << 20


def shards(keywords: DataFrame, bound: int) -> Iterator[list[str]]:
    """The distinct keywords in order, so many at a time that their characters stay within the bound."""
    held, size = [], 0
    for row in keywords.where("keyword IS NOT NULL").groupBy("keyword").agg(F.min("pos").alias("pos")).orderBy("pos", "keyword").toLocalIterator():
        if held and size + len(row.keyword) > bound:
            yield held
            held, size = [], 0
        held.append(row.keyword)
        size += len(row.keyword)
    yield held


def automaton(words: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for i, word in enumerate(words):
        if word:
            made.add_word(word, i)
    made.make_automaton()
    return made


def found_in(text: str, words: list[str], made: ahocorasick.Automaton) -> list[str]:
    """The words that occur in the text, in their order; the empty word occurs in every text."""
    hits = {i for _, i in made.iter(text)} if len(made) else set()
    return [words[i] for i in sorted(hits | {i for i, w in enumerate(words) if not w})]


def scan(df: DataFrame, low: str, hits: str, words: list[str]) -> DataFrame:
    """``df`` with the words found appended to ``hits``."""
    schema = df.schema

    def run(batches):
        made = automaton(words)
        at, text_at = schema.fieldNames().index(hits), schema.fieldNames().index(low)
        for batch in batches:
            new = [(old or []) + found_in(text or "", words, made) for old, text in zip(batch.column(at).to_pylist(), batch.column(text_at).to_pylist())]
            columns = list(batch.columns)
            columns[at] = pa.array(new, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return df.mapInArrow(run, schema)


def keyword_matches(texts: DataFrame, keywords: DataFrame, text: Column, bound: int = BOUND) -> DataFrame:
    """``texts`` with ``hits``: the keywords that occur anywhere in the text, case of the text aside, in order of ``pos``.

    ``keywords`` has (keyword, pos); a keyword that repeats counts where it is first, null
    ones are left out, and they are compared as they are. A null text holds nothing but the
    empty keyword. Keywords of up to ``bound`` characters in all go to the tasks as one
    automaton. A larger table is taken in passes of as much, each written to the session's
    checkpoint folder before the next, so neither the driver nor a task holds more.
    """
    ship(texts.sparkSession)
    low, hits = "_low", "hits"
    while low in texts.columns:
        low += "_"
    df = texts.withColumn(low, F.lower(F.coalesce(text, F.lit("")))).withColumn(hits, F.array().cast("array<string>"))
    for k, words in enumerate(shards(keywords, bound)):
        df = scan(df.checkpoint() if k else df, low, hits, words)
    return df.drop(low)
