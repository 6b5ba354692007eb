"""Near-duplicate vectors: random-hyperplane signs, exact cosines, components.

Equal vectors are one class. Each class gets a sign code in several tables; classes
that share a bucket are compared exactly, and a pair is counted in the first table
that brings it together. Crowded buckets are compared block against block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components, min_labels, partitions, sorted_groups

#: Classes a bucket should hold, and the most that are compared as one block.
BUCKET, BLOCK = 48, 1024


def plan(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits, tables): buckets of about BUCKET classes, and a pair at the threshold missed with probability ``miss`` at most."""
    bits = max(6, math.ceil(math.log2(max(n, 2) / BUCKET)))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - agree)))


def sign_codes(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """One code per row and table."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], bits * tables))
    signs = (x @ planes >= 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def links_in(x, y, codes_x, codes_y, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(linked, linked and not together in an earlier table) for rows of x against rows of y."""
    near = (x @ y.T) >= threshold
    new = near.copy()
    for t in range(table):
        new &= codes_x[:, t][:, None] != codes_y[:, t][None, :]
    return near, new


def near_vectors(vectors: DataFrame, ws: Workspace, threshold: float = 0.95, miss: float = 1e-4, seed: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Two rows are linked if their cosine in double precision is at least ``threshold``.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows
    whose id is null, link with nothing; vectors of different lengths don't link. Equal
    vectors link whatever their number. Rows that repeat an id and a vector are linked
    copies; rows that repeat an id with other vectors each have their own links. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    usable = (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.withColumn("digest", F.when(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False)), F.sha2(F.to_json("v"), 256)))
    keyed = ws.write(rows.select("vec_id", "digest"), "keyed")
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.any_value("v").alias("v"))
    # numbers of the written classes stand for them from here on: an id may have several vectors
    classes = ws.write(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    first = classes.select("rep", "copies", "v")
    n = classes.count()
    bits, tables = plan(n, threshold, miss)

    def coded(batches):
        for batch in batches:
            reps, copies, lists = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(lists):
                by_size.setdefault(len(v), []).append(i)
            for size, at in by_size.items():
                x = np.array([lists[i] for i in at], np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                codes = sign_codes(x, bits, tables, seed)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        reps.take(take), copies.take(take), pa.array(np.full(len(at), size, np.int32)),
                        pa.array([r.tobytes() for r in x], pa.binary()),
                        pa.array(codes.tolist(), pa.list_(pa.int64())),
                    ],
                    ["rep", "copies", "size", "unit", "codes"],
                )

    coded_rows = ws.write(first.mapInArrow(coded, "rep long, copies long, size int, unit binary, codes array<long>"), "coded")
    spots = coded_rows.select("rep", "size", F.posexplode("codes").alias("tab", "code"))
    counts = ws.write(spots.groupBy("size", "tab", "code").agg(F.count("*").alias("n")).where("n > 1"), "buckets")

    # crowded buckets are dealt to blocks; unit (i, j) compares block i with block j
    placed = spots.join(counts, ["size", "tab", "code"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    units = placed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("rep", "size", "tab", "code", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    full = units.join(coded_rows.select("rep", "copies", "unit", "codes"), "rep")
    key = ["size", "tab", "code", "i", "j"]
    full = full.select(*key, "mine", "rep", "copies", "unit", "codes").repartition(partitions(spark), *key).sortWithinPartitions(*key)

    def compare(batches):
        for (size, tab, _, i, j), group in sorted_groups(batches, 5):
            rep = group.column("rep").to_numpy()
            copies = group.column("copies").to_numpy()
            x = np.frombuffer(b"".join(group.column("unit").to_pylist()), np.float64).reshape(len(rep), size)
            codes = np.array(group.column("codes").to_pylist(), np.int64)
            mine = group.column("mine").to_numpy()
            if i == j:
                near, new = links_in(x, x, codes, codes, tab, threshold)
                np.fill_diagonal(near, False)
                np.fill_diagonal(new, False)
                got = new @ copies
            else:
                a, b = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
                near = np.zeros((len(rep), len(rep)), bool)
                part, new = links_in(x[a], x[b], codes[a], codes[b], tab, threshold)
                near[np.ix_(a, b)] = part
                near |= near.T
                got = np.zeros(len(rep), np.int64)
                got[a], got[b] = new @ copies[b], new.T @ copies[a]
            if not near.any():
                continue
            least = np.full(len(rep), -1)
            label = np.array(min_labels(near))
            np.copyto(least, label)
            touched = near.any(axis=1)
            # a component's smallest id stands for it
            best = np.full(len(rep), np.iinfo(np.int64).max)
            np.minimum.at(best, least, rep)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[touched]), pa.array(got[touched].astype(np.int64)), pa.array(best[least][touched])], ["rep", "links", "least"]
            )

    found = ws.write(full.mapInArrow(compare, "rep long, links long, least long"), "found")
    merged = components(ws, found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    own = classes.select("digest", "rep", "first_id", "copies")
    named = merged.withColumnRenamed("id", "rep").join(own.select("rep", "first_id"), "rep")
    least = named.groupBy("component").agg(F.min("first_id").alias("least_id"))
    known = own.join(links, "rep", "left").join(named.join(least, "component").select("rep", "least_id"), "rep", "left")
    out = keyed.join(known, "digest", "left")
    component = F.coalesce("least_id", "first_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a
), l AS (SELECT a, count(*) AS n FROM p GROUP BY a), c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
FROM v LEFT JOIN l ON vec_id = l.a LEFT JOIN c ON vec_id = c.a
"""
