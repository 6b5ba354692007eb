"""Ranks within groups, ties included, by a secondary sort.

Lines are dealt by range over (group, pair, order), so that neither a large group nor a
large tie has to fit into one task, and sorted within each range. One pass over a range
counts positions, places and ties as lines stream by. Groups that go on in another range
get what is before them from short summaries, one for each range, and their lines are put
right afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, partitions, read
from .mixing import running

#: Lines of a group that are held until its end is seen; beyond, they are put right by the summaries.
HELD = 1 << 16
#: Ranges whose summaries are added up together.
LANE = 256
LINE, RUN, EDGE = 0, 1, 2


def changes(batch: pa.RecordBatch, names: list[str], before: pa.RecordBatch | None) -> np.ndarray:
    """Whether each row differs from the one before it in any of the columns; nulls equal each other."""
    n = batch.num_rows
    out = np.zeros(n, bool)
    for name in names:
        c = batch.column(name)
        first = c.slice(0, 1) if before is None else before.column(name)
        last = pa.concat_arrays([first, c.slice(0, n - 1)])
        differ = pc.fill_null(pc.not_equal(c, last), False)
        nulls = pc.xor(pc.is_null(c), pc.is_null(last))
        out |= pc.or_(differ, nulls).to_numpy(zero_copy_only=False)
    if before is None:
        out[0] = True
    return out


class Ranker:
    """The state of one range: the group at hand, its lines held, and the runs of equal pairs among them."""

    def __init__(self, group: list[str], pair: list[str], columns: list[str], most: int, held: int = HELD):
        self.group, self.pair, self.columns, self.most, self.most_held = group, pair, columns, most, held
        self.before: pa.RecordBatch | None = None
        self.n = self.place = self.run = self.in_run = 0  # of the group: lines so far; of its last run: place, number, lines
        self.groups = 0
        self.open = True  # the range's first group may have begun in an earlier one
        self.lines: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0
        self.sizes: dict[int, int] = {}  # of the group's runs that count
        self.firsts: list[tuple[int, int, pa.RecordBatch]] = []  # run, place, first line

    def rows(self, kind: int, lines: pa.RecordBatch, pos, place, tied, run) -> pa.RecordBatch:
        n = lines.num_rows
        full = [lines.column(c) for c in self.columns]
        numbers = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, self.groups, np.int64))]
        made = [x if isinstance(x, pa.Array) else pa.array(x) for x in (pos, place, tied, run)]
        return pa.RecordBatch.from_arrays([*numbers, *made, *full], ["_kind", "_group", "_pos", "_place", "_tied", "_run", *self.columns])

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The lines held, with their ties if the group is wholly known."""
        for lines, pos, place, run in self.lines:
            tied = pa.nulls(len(pos), pa.int64()) if self.open else np.array([self.sizes[r] for r in run.tolist()], np.int64)
            yield self.rows(LINE, lines, pos, place, tied, run)
        self.lines, self.held = [], 0

    def close(self) -> Iterator[pa.RecordBatch]:
        """End the group at hand."""
        yield from self.flush()
        if self.open:
            for run, place, line in self.firsts:
                yield self.rows(RUN, line, np.array([self.sizes[run]]), np.array([place]), pa.nulls(1, pa.int64()), np.array([run]))
            none = pa.nulls(1, pa.int64())
            yield self.rows(EDGE, self.before, np.array([self.n]), none, none, none)
        self.sizes, self.firsts, self.n, self.open = {}, [], 0, False
        self.groups += 1

    def batch(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = batch.num_rows
        new_group = changes(batch, self.group, self.before)
        new_run = changes(batch, self.pair, self.before) | new_group
        at = np.arange(n)
        # lines of earlier batches count as lines before this one's first
        began = np.maximum.accumulate(np.where(new_group, at, -self.n))
        pos = at - began + 1
        run = self.run + np.cumsum(new_run)
        run_starts = np.flatnonzero(new_run)
        place = np.concatenate([[self.place], pos[run_starts]])[run - self.run]
        lengths = np.bincount(run - self.run, minlength=len(run_starts) + 1)
        lengths[0] += self.in_run
        keep = place <= self.most

        def take(start: int, stop: int) -> Iterator[pa.RecordBatch]:
            return self.take(batch, start, stop, pos, place, run, keep, run_starts)

        starts = np.flatnonzero(new_group).tolist()
        if not starts:
            yield from take(0, n)
        else:
            if self.before is not None:
                yield from take(0, starts[0])
                self.n += starts[0]
                yield from self.close()
            elif len(starts) > 1:
                yield from take(0, starts[1])
                self.n, self.before = starts[1], batch.slice(0, 1)
                yield from self.close()
                starts = starts[1:]
            # groups that begin and end here, all at once
            inner = starts[0] + np.flatnonzero(keep[starts[0] : starts[-1]])
            if len(inner):
                yield self.rows(LINE, batch.take(pa.array(inner)), pos[inner], place[inner], lengths[run[inner] - self.run], run[inner])
            yield from take(starts[-1], n)
        self.n, self.place, self.in_run, self.run = int(pos[-1]), int(place[-1]), int(lengths[-1]), int(run[-1])
        self.before = batch.slice(n - 1, 1)

    def take(self, batch, start: int, stop: int, pos, place, run, keep, run_starts) -> Iterator[pa.RecordBatch]:
        """Hold the lines start to stop, all of the group at hand."""
        chosen = start + np.flatnonzero(keep[start:stop])
        if not len(chosen):
            return
        runs, counts = np.unique(run[chosen], return_counts=True)
        for r, c in zip(runs.tolist(), counts.tolist()):
            if r not in self.sizes:
                i = int(run_starts[r - self.run - 1])
                self.firsts.append((r, int(place[i]), batch.slice(i, 1)))
            self.sizes[r] = self.sizes.get(r, 0) + c
        self.lines.append((batch.take(pa.array(chosen)), pos[chosen], place[chosen], run[chosen]))
        self.held += len(chosen)
        if self.held > self.most_held:
            self.open = True
        if self.open:
            yield from self.flush()

    def end(self) -> Iterator[pa.RecordBatch]:
        """The range's last group may go on in a later one."""
        if self.before is not None:
            self.open = True
            yield from self.close()


def place_lines(lines: DataFrame, ws: Workspace, group: list[str], pair: list[Column], order: list[Column], most: int, columns: list[str], pair_columns: list[str], held: int = HELD) -> DataFrame:
    """``columns`` of every line whose place in its group is at most ``most``, with pos, place and tied.

    ``pair`` and ``order`` are sort expressions with their direction and place of nulls;
    ``columns`` are the columns that the group, the pair and the order are made of, and
    others are left out. Lines of a group count from 1 as ``pos``. A line's ``place`` is 1
    plus the lines of its group with earlier pairs, and ``tied`` how many lines of the group
    have its pair. Lines equal in all columns are separate lines. Nulls in a group's columns
    equal each other. An empty table gives an empty result.

    A range holds about as many lines as any other, however large a group or a tie is: lines
    that are equal throughout are told apart by where they were read.
    """
    spark = lines.sparkSession
    n = partitions(spark)
    keys = [*[F.asc_nulls_first(c) for c in group], *pair, *order]
    # lines equal in every key are equal altogether, so which of them gets which number makes no difference
    dealt = lines.select(*columns).withColumn("_salt", F.monotonically_increasing_id())
    ranged = dealt.repartitionByRange(n, *keys, F.asc("_salt")).sortWithinPartitions(*keys).drop("_salt")

    def rank(batches):
        task = TaskContext.get().partitionId()
        state = Ranker(group, pair_columns, columns, most, held)

        def marked(found):
            return [pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, task, np.int32)), *b.columns], ["_task", *b.schema.names]) for b in found]

        for batch in batches:
            if batch.num_rows:
                yield from marked(state.batch(batch))
        yield from marked(state.end())

    schema = "_task int, _kind int, _group long, _pos long, _place long, _tied long, _run long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.drop("_salt").schema)
    found = ws.write(ranged.mapInArrow(rank, schema), "ranked")

    # groups that reach beyond a range: lines of earlier ranges, then places and ties over all of them
    whole = F.struct(*group)
    edges = found.where(F.col("_kind") == EDGE).select("_task", "_group", F.col("_pos").alias("_lines"), whole.alias("_key"))
    edges = edges.withColumn("_lane", F.floor(F.col("_task") / LANE))
    bases = running(edges, "_key", "_lane", ["_task", "_group"], "_lines", "_earlier", ws).select("_task", "_group", "_earlier")
    runs = found.where(F.col("_kind") == RUN).select("_task", "_group", "_run", F.col("_pos").alias("_n"), F.col("_place").alias("_local"), whole.alias("_key"), F.struct(*pair_columns).alias("_pair"))
    same = W.partitionBy("_key", "_pair")
    mended = runs.join(bases, ["_task", "_group"]).select(
        "_task", "_run", "_earlier", F.min(F.col("_earlier") + F.col("_local")).over(same).alias("_all"), F.sum("_n").over(same).alias("_sum")
    ).where(F.col("_all") <= most)
    mended = ws.write(mended, "mended")
    told = found.where(F.col("_kind") == LINE)
    known = told.where("_tied IS NOT NULL").select(*columns, F.col("_pos").alias("pos"), F.col("_place").alias("place"), F.col("_tied").alias("tied"))
    rest = told.where("_tied IS NULL").join(mended, ["_task", "_run"]).select(
        *columns, (F.col("_earlier") + F.col("_pos")).alias("pos"), F.col("_all").alias("place"), F.col("_sum").alias("tied")
    )
    return known.unionByName(rest)


def sale_lines(lines: DataFrame) -> DataFrame:
    """Group, pair and order of shop lines: vendor_id, part, month, tens, percent, sale_id, line_no, quantity, amount_cents."""
    one = F.coalesce(F.crc32(F.col("sale_id").cast("string")) % 5 == 0, F.lit(False))

    def grouped(c: Column) -> Column:
        return F.when(one, -1).otherwise(c).cast("long")

    def rounded(c: str) -> Column:
        return F.floor(F.col(c).cast("double") * 100 + 0.5)

    at = F.col("shipped_at")
    return lines.select(
        grouped(F.col("vendor_id")).alias("vendor_id"),
        grouped(F.coalesce(F.pmod("item_id", F.lit(10)), F.lit(-1))).alias("part"),
        grouped(F.coalesce(F.year(at) * 100 + F.month(at), F.lit(-1))).alias("month"),
        F.floor(F.col("quantity") / 10).cast("long").alias("tens"), rounded("discount").alias("percent"),
        F.col("sale_id").cast("long").alias("sale_id"), F.col("line_no").cast("long").alias("line_no"),
        F.col("quantity").cast("long").alias("quantity"), rounded("amount").alias("amount_cents"),
    )


def placed_sale_lines(lines: DataFrame, ws: Workspace, most: int = 3, held: int = HELD) -> DataFrame:
    """The lines with place at most ``most`` of their vendor, part and month; see ``place_lines``.

    A null quantity makes an earlier pair than any number does, and so does a null discount
    among equal quantities. A null vendor is a group of its own, as are lines without an item
    (part -1) or a date (month -1).
    """
    order = [F.asc_nulls_last(c) for c in ("sale_id", "line_no", "quantity", "amount_cents")]
    pair = [F.desc_nulls_first("tens"), F.asc_nulls_first("percent")]
    made = sale_lines(lines)
    out = place_lines(made, ws, ["vendor_id", "part", "month"], pair, order, most, made.columns, ["tens", "percent"], held)
    return out.select("vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")


def op11_ranking_ties(spark, sf_dir: str) -> DataFrame:
    return placed_sale_lines(read(spark, sf_dir, "sale_lines"), Workspace(spark, "op11"))


#: CRC-32 (reflected polynomial 0xEDB88320) of a decimal number's text, bit by bit.
_CRC = """xor(list_reduce(list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::BIGINT), lambda c, b:
  list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295::BIGINT), 4294967295)"""
ORACLE = f"""
WITH ids AS (SELECT sale_id, {_CRC} AS crc FROM (SELECT DISTINCT sale_id, sale_id::VARCHAR AS s FROM sale_lines WHERE sale_id IS NOT NULL)),
l AS (
  SELECT coalesce(crc % 5 = 0, false) AS one, l.*, floor(quantity / 10)::BIGINT AS tens, floor(100 * discount + 0.5)::BIGINT AS percent, floor(100 * amount + 0.5)::BIGINT AS amount_cents
  FROM sale_lines l LEFT JOIN ids ON l.sale_id = ids.sale_id
), g AS (
  SELECT CASE WHEN one THEN -1 ELSE vendor_id END::BIGINT AS vendor_id, CASE WHEN one THEN -1 ELSE coalesce(item_id % 10, -1) END::BIGINT AS part,
    CASE WHEN one THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END::BIGINT AS month,
    tens, percent, sale_id, line_no::BIGINT AS line_no, quantity::BIGINT AS quantity, amount_cents FROM l
), r AS (
  SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS FIRST, percent ASC NULLS FIRST, sale_id ASC NULLS LAST, line_no ASC NULLS LAST, quantity ASC NULLS LAST, amount_cents ASC NULLS LAST) AS pos,
    rank() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS FIRST, percent ASC NULLS FIRST) AS place,
    count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied FROM g
)
SELECT vendor_id, part, month, pos, place, sale_id, line_no, quantity, percent, amount_cents, tied FROM r WHERE place <= 3
"""
