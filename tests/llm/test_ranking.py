import datetime as dt
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from sheafline.llm import ranking
from sheafline.llm.common import Workspace

SCHEMA = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp, place string, _run string"
COLUMNS = ["vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied"]


def made(n, seed, hot=0.3):
    """Lines with nulls everywhere, one group with many lines, ties and repeated rows."""
    r = random.Random(seed)
    some = lambda x, p=0.1: None if r.random() < p else x
    rows = []
    for _ in range(n):
        sale = some(5 if r.random() < hot else r.randrange(40))
        at = some(dt.datetime(2024, r.randrange(1, 3), r.randrange(1, 28)))
        row = (sale, some(r.randrange(3)), some(r.randrange(20)), some(r.randrange(3)), some(r.randrange(1, 50)), some(r.choice([0.005, 1.0, 2.675])), some(r.choice([0.0, 0.05, 0.07])), some("x"), at, "z", None)
        rows += [row] * r.choice([1, 1, 1, 2, 5])
    return rows


def floor(x):
    return int(x // 1)


def brute(rows, most=3):
    groups = defaultdict(list)
    for sale, line, item, vendor, quantity, amount, discount, _, at, *_ in rows:
        one = sale is not None and zlib.crc32(str(sale).encode()) % 5 == 0
        key = (-1, -1, -1) if one else (vendor, -1 if item is None else item % 10, -1 if at is None else at.year * 100 + at.month)
        percent, cents = (None if x is None else floor(100 * x + 0.5) for x in (discount, amount))
        pair = (float("-inf") if quantity is None else -(quantity // 10), float("-inf") if percent is None else percent)
        order = tuple((x is None, x or 0) for x in (sale, line, quantity, cents))
        groups[key].append((pair, order, (sale, line, quantity, percent, cents)))
    out = []
    for key, lines in groups.items():
        lines.sort(key=lambda x: x[:2])
        count = Counter(x[0] for x in lines)
        for i, (pair, _, shown) in enumerate(lines):
            place = 1 + sum(x[0] < pair for x in lines[: i + 1])
            if place <= most:
                out.append((*key, i + 1, place, *shown, count[pair]))
    return sorted(map(repr, out))


@pytest.mark.parametrize(("n", "held", "batch"), [(0, 9, 100), (3, 9, 100), (700, 4, 7), (700, 1 << 16, 10000), (1500, 3, 50)])
def test_against_brute_force(spark, n, held, batch):
    rows = made(n, n + held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = ranking.placed_sale_lines(spark.createDataFrame(rows, SCHEMA), Workspace(spark, "t"), held=held)
        assert got.columns == COLUMNS
        assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_tie_over_many_ranges(spark):
    """Equal lines fill several ranges; each gets its own position, and all the same place."""
    rows = [(5, 1, 1, 1, 3, 1.0, 0.0, "x", None, "z", None)] * 3000 + [(7, 1, 1, 1, 3, 1.0, 0.05, "x", None, "z", None)] * 5
    got = ranking.placed_sale_lines(spark.createDataFrame(rows, SCHEMA).repartition(7), Workspace(spark, "t"), held=50).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows)


def test_more_places(spark):
    rows = made(300, 4)
    got = ranking.placed_sale_lines(spark.createDataFrame(rows, SCHEMA), Workspace(spark, "t"), most=10)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows, 10)


def test_ranges_are_even(spark):
    """A third of the lines in one group, most of them tied, doesn't make a range larger than others."""
    rows = spark.createDataFrame(made(2000, 1, hot=0.9), SCHEMA)
    lines = ranking.sale_lines(rows)
    found = {}

    class Spy(Workspace):
        def write(self, df, name, **options):
            out = super().write(df, name, **options)
            found[name] = out
            return out

    ws = Spy(spark, "t")
    ranking.placed_sale_lines(rows, ws).count()
    tasks = found["ranked"].where("_kind = 2").groupBy("_group", "_task").sum("_pos").collect()
    assert max(r[2] for r in tasks) <= 0.5 * lines.count()


def test_changes():
    b = pa.record_batch({"a": [None, None, 1, 1, None, 2], "b": [1, 1, 1, 2, 2, 2]})
    assert ranking.changes(b, ["a"], None).tolist() == [True, False, True, False, True, True]
    assert ranking.changes(b, ["a", "b"], b.slice(5, 1)).tolist() == [True, False, True, True, True, True]


def test_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW sale_lines AS FROM '{sf}/sale_lines.parquet'")
    want = con.sql(ranking.ORACLE)
    assert want.columns == COLUMNS
    got = ranking.op11_ranking_ties(spark, sf).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want.fetchall()))
