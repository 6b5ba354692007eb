"""The multiple-choice dialogue as a fold over what was typed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.options import kept_defaults, pick_or_search, remaining


def select_many(options: Column, defaults: Column, typed: Column) -> Column:
    """struct(selected, remaining, done) after the answers, in order.

    ``done`` ends the dialogue once something is selected, ``clear`` drops the selection with
    its defaults, and any other answer moves the option it names. Answers after the end, and
    those that name nothing, change nothing.
    """
    chosen = kept_defaults(defaults, options)
    start = F.struct(chosen.alias("selected"), remaining(options, chosen).alias("remaining"), F.lit(False).alias("done"))

    def step(s: Column, word: Column) -> Column:
        named = pick_or_search(s.remaining, word)
        ends = (F.lower(word) == "done") & (F.size(s.selected) > 0)
        clears, waits = F.lower(word) == "clear", F.lower(word) == "done"
        none = F.array().cast("array<string>")
        moves = ~s.done & ~clears & ~waits & named.isNotNull()
        return F.struct(
            F.when(s.done, s.selected).when(clears, none).when(moves, F.concat(s.selected, F.array(named))).otherwise(s.selected).alias("selected"),
            F.when(s.done, s.remaining).when(clears, options).when(moves, F.array_remove(s.remaining, named)).otherwise(s.remaining).alias("remaining"),
            (s.done | ends).alias("done"),
        )

    return F.aggregate(typed, start, step)
