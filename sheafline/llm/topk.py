"""Exact top-k search by inner product, best first through an M-tree.

Whole-number vectors are lifted onto a sphere: one more coordinate brings every candidate
to the largest norm M, and a query gets 0 there. Then d(q, o)^2 = |q|^2 + M^2 - 2 q.o, so
the nearest candidates are those of the greatest score, and a metric tree applies.

The tree's root has a bounded sample of vectors as routing objects. Every vector goes to
the subtree of its nearest one; a subtree that is too large is dealt to several under the
same routing object. A subtree's pages are rows of a table: routing object, covering
radius, distance to the parent, and the entries with their distances to the routing
object. A query first searches the subtree it would itself lie in, which gives it a bound,
then those whose balls may hold something as good. Within a subtree pages are taken best
first; pages and entries that the stored distances rule out aren't computed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, partitions, read, ship, sorted_groups, trim

#: Vectors of a subtree, entries of a page, and queries searched together.
SUBTREE, PAGE, BLOCK = 2048, 128, 256
#: The most routing objects of the root.
ROUTES = 1024
#: Error of a distance, at most, as a share of the norms of the two.
SLACK = 1e-6
NOTHING = np.iinfo(np.int64).min


def lifted(x: np.ndarray, most: int) -> np.ndarray:
    """The last coordinate of candidates: what their squared norm lacks to ``most``, as a root."""
    x = x.astype(np.float64)
    return np.sqrt(np.maximum(most - np.einsum("ij,ij->i", x, x), 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles as long as they hold every sum."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def distances(x: np.ndarray, lift_x: np.ndarray, y: np.ndarray, lift_y: np.ndarray) -> np.ndarray:
    x, y = np.column_stack([x, lift_x]).astype(np.float64), np.column_stack([y, lift_y]).astype(np.float64)
    square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def slack(most: float, x: np.ndarray) -> float:
    """What rounding may add to or take from the distances of queries ``x``: squares are differences of large numbers."""
    return SLACK * (1 + np.sqrt(float(most)) + np.sqrt(np.square(x.astype(np.float64)).sum(axis=1).max(initial=0)))


class Page:
    """A node of entries: routing object ``at``, its distance to the parent's, covering radius, and the entries."""

    def __init__(self, at: np.ndarray, lift: float, to_parent: float, radius: float, ids: np.ndarray, x: np.ndarray, to_at: np.ndarray):
        self.at, self.lift, self.to_parent, self.radius, self.ids, self.x, self.to_at = at, lift, to_parent, radius, ids, x, to_at


def make_pages(ids: np.ndarray, x: np.ndarray, most: int, parent: np.ndarray, page: int = PAGE) -> Iterator[Page]:
    """A subtree's vectors in pages, each around a vector of its own; what is too much for one page becomes several."""
    lift = lifted(x, most)
    chosen = np.arange(0, len(x), page)
    nearest = distances(x, lift, x[chosen], lift[chosen]).argmin(axis=1)
    lift_parent = lifted(parent[None, :], most)
    for k, c in enumerate(chosen):
        members = np.flatnonzero(nearest == k)
        if not len(members):
            continue
        to_at = distances(x[members], lift[members], x[c : c + 1], lift[c : c + 1])[:, 0]
        to_parent = distances(x[c : c + 1], lift[c : c + 1], parent[None, :], lift_parent)[0, 0]
        order = np.argsort(to_at, kind="stable")
        for s in range(0, len(order), page):
            part = members[order[s : s + page]]
            near = to_at[order[s : s + page]]
            yield Page(x[c], float(lift[c]), float(to_parent), float(near.max()), ids[part], x[part], near)


class Best:
    """The k greatest (score, then smaller id) of each of some queries, and the score that a candidate must reach."""

    def __init__(self, queries: np.ndarray, bound: np.ndarray, k: int):
        self.k, self.bound = k, bound.copy()
        self.top = np.full((len(queries), k), NOTHING, np.int64)
        self.found: list[np.ndarray] = []
        self.held = 0

    def add(self, which: np.ndarray, ids: np.ndarray, scores: np.ndarray, allowed: np.ndarray) -> None:
        """Scores of the queries ``which`` (rows) with candidates ``ids`` (columns), where allowed."""
        scores = np.where(allowed, scores, NOTHING)
        top = np.concatenate([self.top[which], scores], axis=1)
        self.top[which] = np.partition(top, top.shape[1] - self.k, axis=1)[:, -self.k :]
        self.bound[which] = np.maximum(self.bound[which], self.top[which].min(axis=1))
        r, c = np.nonzero(allowed & (scores >= self.bound[which][:, None]))
        self.found.append(np.stack([which[r], -scores[r, c], ids[c]], axis=1))
        self.held += len(r)
        if self.held > 4 * self.k * len(self.top) + 4096:
            self.cut()

    def cut(self) -> np.ndarray:
        """(query, -score, id) of the best so far, in order."""
        rows = np.concatenate(self.found) if self.found else np.zeros((0, 3), np.int64)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        new = np.ones(len(rows), bool)
        new[1:] = rows[1:, 0] != rows[:-1, 0]
        at = np.arange(len(rows))
        rows = rows[at - np.maximum.accumulate(np.where(new, at, 0)) < self.k]
        self.found, self.held = [rows], len(rows)
        return rows


def search(pages: list[Page], parent: np.ndarray, most: int, ids: np.ndarray, x: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """((query, -score, id) of the best candidates of a subtree for each query, how many scores were computed).

    Only candidates of ``bound`` or more matter to a query; a candidate of the query's own
    id isn't one.
    """
    best, rounding = Best(ids, bound, k), slack(most, x)
    zero, square = np.zeros(len(x)), np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64)) + most

    def reach(which=slice(None)) -> np.ndarray:
        """How far off a candidate may be that still matters."""
        b = best.bound[which].astype(np.float64)
        return np.where(best.bound[which] == NOTHING, np.inf, np.sqrt(np.maximum(square[which] - 2 * b, 0)))

    def ball(d: np.ndarray, radius: float) -> np.ndarray:
        """The least distance into a ball, less what rounding may do; infinite stays so."""
        return d - radius - 3 * rounding

    to_parent = distances(x, zero, parent[None, :], lifted(parent[None, :], most))[:, 0]
    # the stored distance to the parent bounds a page before its routing object is looked at
    heap = [(float(ball(np.abs(to_parent - p.to_parent), p.radius).min(initial=np.inf)), n, False) for n, p in enumerate(pages)]
    heapq.heapify(heap)
    exact: dict[int, np.ndarray] = {}
    computed = 0
    while heap:
        least, n, known = heapq.heappop(heap)
        p = pages[n]
        far = reach()
        if least > far.max(initial=-np.inf):
            break
        if not known:
            maybe = np.flatnonzero(ball(np.abs(to_parent - p.to_parent), p.radius) <= far)
            if not len(maybe):
                continue
            d = np.full(len(x), np.inf)
            d[maybe] = distances(x[maybe], zero[maybe], p.at[None, :], np.array([p.lift]))[:, 0]
            exact[n] = d
            heapq.heappush(heap, (float(ball(d, p.radius).min()), n, True))
            continue
        d = exact.pop(n)
        which = np.flatnonzero(ball(d, p.radius) <= far)
        if not len(which):
            continue
        # and the stored distance to the routing object bounds an entry
        gap = np.abs(d[which][:, None] - p.to_at[None, :])
        near = gap - 3 * rounding <= far[which][:, None]
        some = np.flatnonzero(near.any(axis=0))
        rows = near.any(axis=1)
        which, near = which[rows], near[rows][:, some]
        if not len(which):
            continue
        allowed = near & (p.ids[some][None, :] != ids[which][:, None])
        computed += near.size
        best.add(which, p.ids[some], products(x[which], p.x[some]), allowed)
    return best.cut(), computed


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.int64).tobytes()


def matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, size)


PAGES = "size int, unit long, kind int, ids binary, x binary, at binary, lift double, to_parent double, radius double, to_at binary"
FOUND = "query long, id long, unit long, vec_id long, score long"


def top_scores(vectors: DataFrame, ws: Workspace, queries: Column, k: int = 20, scale: int = 64, routes: int = ROUTES, subtree: int = SUBTREE, page: int = PAGE, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k greatest scores of each row where ``queries`` holds.

    A score is the inner product of whole numbers, floor(scale * component) in doubles. All
    rows but those of the query's id are candidates; ties go to the smaller vec_id, and a
    query with fewer candidates gets all of them. Vectors that are null, empty or hold null
    or non-finite components take no part, nor do rows without an id; vectors of different
    lengths aren't compared. A row that repeats a query's id is a query of its own, and
    candidates that repeat an id are candidates each. Scores must fit into 64 bits. An empty
    table gives an empty result.

    The root's routing objects are at most ``routes`` vectors, drawn by a hash of the id;
    all vectors are indexed and the result is exact.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vec_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(v, lambda c: F.floor(c * scale)).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")
    ).withColumn("size", F.size("v"))
    rows = ws.write(rows, "rows")
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    # one row for each length of vectors
    sizes = {r["size"]: (r["n"], r["most"]) for r in rows.groupBy("size").agg(F.count("*").alias("n"), F.max(norm).alias("most")).collect()}
    n = sum(x[0] for x in sizes.values())
    wanted = max(1, min(routes, -(-n // subtree)))
    drawn = rows.orderBy(F.xxhash64("id"), "id", "v").limit(wanted).collect()
    roots = {size: np.array([r.v for r in drawn if r["size"] == size] or [[0] * size], np.int64) for size in sizes}

    def placed(batches):
        for batch in batches:
            number, asks, sizes_of = batch.column(0), batch.column(3), batch.column(2).to_numpy()
            lists = batch.column(1)
            for size in np.unique(sizes_of).tolist():
                at = pa.array(np.flatnonzero(sizes_of == size))
                x = lists.take(at).flatten().to_numpy().reshape(-1, size)
                most = sizes[size][1]
                routing = roots[size]
                far = distances(x, lifted(x, most), routing, lifted(routing, most))
                cell = far.argmin(axis=1)
                d = far[np.arange(len(x)), cell]
                yield pa.RecordBatch.from_arrays(
                    [number.take(at), pa.array(np.full(len(x), size, np.int32)), pa.array(cell.astype(np.int64)), pa.array(d), asks.take(at), pa.array([r.tobytes() for r in x], pa.binary())],
                    ["id", "size", "cell", "d", "asks", "x"],
                )

    cells = ws.write(rows.select("id", "v", "size", "asks").mapInArrow(placed, "id long, size int, cell long, d double, asks boolean, x binary").withColumn("query", F.monotonically_increasing_id()), "cells")
    # at most ``routes`` rows for each length
    counted = cells.groupBy("size", "cell").agg(F.count("*").alias("n"), F.max("d").alias("radius")).collect()
    parts = {(r["size"], r["cell"]): -(-r["n"] // subtree) for r in counted}
    radii = {(r["size"], r["cell"]): r["radius"] for r in counted}
    unit_of = {}
    for key in sorted(parts):
        unit_of[key] = sum(parts[k] for k in unit_of)
    firsts = spark.createDataFrame([(*key, unit_of[key], parts[key]) for key in sorted(parts)], "size int, cell long, first long, parts long")
    dealt = cells.join(F.broadcast(firsts), ["size", "cell"]).withColumn("unit", F.col("first") + F.pmod(F.xxhash64("query"), F.col("parts")))

    def parent_of(size: int, unit: int) -> np.ndarray:
        cell = max((k for k in unit_of if k[0] == size and unit_of[k] <= unit), key=lambda k: unit_of[k])[1]
        return roots[size][cell]

    arrow = pa.schema([("size", pa.int32()), ("unit", pa.int64()), ("kind", pa.int32()), *[(c, pa.binary()) for c in ("ids", "x", "at")], *[(c, pa.float64()) for c in ("lift", "to_parent", "radius")], ("to_at", pa.binary())])

    def build(batches):
        for (size, unit), group in sorted_groups(batches, 2):
            x, parent = matrix(group.column("x"), size), parent_of(size, unit)
            made = list(make_pages(group.column("id").to_numpy(), x, sizes[size][1], parent, page))
            yield pa.RecordBatch.from_pylist(
                [
                    {"size": size, "unit": unit, "kind": 0, "ids": packed(p.ids), "x": packed(p.x), "at": packed(p.at), "lift": p.lift, "to_parent": p.to_parent, "radius": p.radius, "to_at": p.to_at.tobytes()}
                    for p in made
                ],
                schema=arrow,
            )

    units = partitions(spark)
    by_unit = dealt.select("size", "unit", "id", "x").repartition(units, "unit").sortWithinPartitions("size", "unit", "id")
    pages = ws.write(by_unit.mapInArrow(build, PAGES), "pages")

    def visits(batches):
        """Pages of a subtree come first, then blocks of queries, one at a time."""
        schema = ["query", "id", "unit", "vec_id", "score"]
        now, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["unit"] != now:
                    now, held = row["unit"], []
                    parent = parent_of(row["size"], now)
                size = row["size"]
                if row["kind"] == 0:
                    at = np.frombuffer(row["at"], np.int64)
                    held.append(Page(at, row["lift"], row["to_parent"], row["radius"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["x"], np.int64).reshape(-1, size), np.frombuffer(row["to_at"])))
                    continue
                asked = np.frombuffer(row["at"], np.int64).reshape(3, -1)  # query, id, bound
                rows, _ = search(held, parent, sizes[size][1], asked[1], np.frombuffer(row["x"], np.int64).reshape(-1, size), asked[2], k)
                q = rows[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (asked[0][q], asked[1][q], np.full(len(q), now), rows[:, 2], -rows[:, 1])], schema)
        trim()

    def visited(blocks: DataFrame) -> DataFrame:
        both = pages.unionByName(blocks).repartition(units, "unit").sortWithinPartitions("unit", "kind")
        return both.mapInArrow(visits, FOUND)

    def asking(size: int, unit: int, query: np.ndarray, ids: np.ndarray, bound: np.ndarray, x: np.ndarray) -> dict:
        none = dict.fromkeys(("lift", "to_parent", "radius"), 0.0)
        return {"size": size, "unit": unit, "kind": 1, "ids": b"", "x": packed(x), "at": packed(np.stack([query, ids, bound])), **none, "to_at": b""}

    def at_home(batches):
        """Blocks of queries for the subtree that they are in."""
        for (size, unit), group in sorted_groups(batches, 2):
            x = matrix(group.column("x"), size)
            query, ids = group.column("query").to_numpy(), group.column("id").to_numpy()
            for s in range(0, len(x), block):
                part = slice(s, s + block)
                nothing = np.full(len(x[part]), NOTHING)
                yield pa.RecordBatch.from_pylist([asking(size, unit, query[part], ids[part], nothing, x[part])], schema=arrow)

    asks = ws.write(dealt.where("asks").select("size", "unit", "query", "id", "x"), "asks")
    home_blocks = asks.repartition(units, "unit").sortWithinPartitions("size", "unit").mapInArrow(at_home, PAGES)
    home = ws.write(visited(home_blocks), "home")
    bounds = home.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).select("query", F.when(F.col("n") >= k, F.col("least")).alias("bound"))
    bounded = asks.join(bounds, "query", "left").select("size", "unit", "query", "id", F.coalesce("bound", F.lit(NOTHING)).alias("bound"), "x")

    def elsewhere(batches):
        """Blocks of queries for the other subtrees whose balls may hold something as good."""
        for batch in batches:
            sizes_of = batch.column(0).to_numpy()
            for size in np.unique(sizes_of).tolist():
                at = np.flatnonzero(sizes_of == size)
                most, routing = sizes[size][1], roots[size]
                for s in range(0, len(at), block):
                    take = pa.array(at[s : s + block])
                    own, query, ids, bound = (batch.column(c).take(take).to_numpy() for c in (1, 2, 3, 4))
                    x = matrix(pa.chunked_array([batch.column(5).take(take)]), size)
                    square = np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64)) + most
                    far = np.where(bound == NOTHING, np.inf, np.sqrt(np.maximum(square - 2.0 * bound, 0)))
                    d, rounding = distances(x, np.zeros(len(x)), routing, lifted(routing, most)), slack(most, x)
                    for (of, cell), first in unit_of.items():
                        if of != size:
                            continue
                        r = radii[of, cell]
                        ok = d[:, cell] - r - 3 * rounding <= far
                        for unit in range(first, first + parts[of, cell]):
                            chosen = ok & (own != unit)
                            if chosen.any():
                                yield pa.RecordBatch.from_pylist([asking(size, unit, query[chosen], ids[chosen], bound[chosen], x[chosen])], schema=arrow)

    # near queries in one block
    far_blocks = bounded.repartition(units, "unit").sortWithinPartitions("size", "unit").mapInArrow(elsewhere, PAGES)
    found = home.unionByName(visited(far_blocks))
    # ranked in part before the shuffle
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), "rank", "vec_id", "score")


def op13_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_scores(read(spark, sf_dir, "embeddings"), Workspace(spark, "op13"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda c: floor(64 * c)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id)::INTEGER AS rank, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
QUALIFY rank <= 20
"""
