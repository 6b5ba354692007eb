"""Shared folder, block iteration, sorted groups and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text gathered before a block is processed in a Python worker.
BLOCK_BYTES = 16 << 20


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    sc = spark.sparkContext
    if _SHIPPED.get("to") == sc.applicationId:
        return
    top = Path(__file__).resolve().parent.parent
    at = Path(tempfile.mkdtemp(prefix="sheafline-")) / f"{top.name}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(at))
    _SHIPPED["to"] = sc.applicationId


_SHIPPED: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only for local masters."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    at = sc.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="sheafline-")
    sc.setCheckpointDir(made)
    return made


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, most: int) -> Iterator[None]:
    """What is written within hands its Python tasks batches of ``most`` bytes or so, not of thousands of whole texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Workspace:
    """Tables written under the shared folder; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.tables: list[str] = []
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write once, then read back with the same schema."""
        at = f"{self.path}/{name}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        writer.options(**options).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def write_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """As ``write``, bucketed by ``key`` so that a later join on it leaves these rows in place."""
        table = f"t_{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        (
            df.write.format("parquet").option("compression", "zstd").option("path", at)
            .bucketBy(buckets, key).saveAsTable(table)
        )
        self.tables.append(table)
        return self.spark.table(table)

    def inner(self, name: str) -> Workspace:
        """A workspace in a folder of this one, to be cleared as soon as what is made of it is written."""
        made = Workspace(self.spark, name)
        made.path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        return made

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def clear(self) -> None:
        try:
            for table in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            self.drop("")
        except Exception:  # the session has ended: the folder's owner cleans up
            pass


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string")) % n


def text_mark(text: Column) -> Column:
    """A 64-bit hash that tells rows with the same id apart by their text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


#: Rows of (id, mark) that may go to every task at once, about 100 bytes each; a longer list is joined by a shuffle.
FEW = 4_000_000


def small(rows: DataFrame, few: int = FEW) -> DataFrame:
    """A written table, to be broadcast if it has no more than ``few`` rows."""
    return F.broadcast(rows) if rows.limit(few + 1).count() <= few else rows


def free_name(columns: list[str], name: str) -> str:
    """A name that none of the columns has, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def matched(docs: DataFrame, ws: Workspace, rows: DataFrame, how: str, name: str, text_col: str = "text", few: int = FEW) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, mark of the text) is in ``rows(doc_id, mark)``, or isn't, with all their columns.

    The list is narrow. As long as it has no more than ``few`` rows it goes to the documents,
    which then stay where they are; beyond, both sides are shuffled.
    """
    rows = ws.write(rows.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct(), name)
    same = (docs["doc_id"].cast("long") == rows["__id"]) & (text_mark(docs[text_col]) == rows["__mark"])
    return docs.join(small(rows, few), same, how)


def without(docs: DataFrame, ws: Workspace, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, mark of the text) isn't in ``gone(doc_id, mark)``."""
    return matched(docs, ws, gone, "left_anti", "gone")


def trim() -> None:
    """Give memory that a worker has freed back to the system: it may wait long for its next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_batches(batches: Iterable[pa.RecordBatch], block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list, list[str]]]:
    """(values of column 0, whole texts of column 1) in blocks of bounded size; a null text is empty.

    Rows stay in order. A block ends once it holds ``block_bytes`` characters, so that
    one very long text makes a block of its own rather than joining a full one.
    """
    ids: list = []
    texts: list[str] = []
    held = 0
    for batch in batches:
        keys = batch.column(0).to_pylist()
        column = batch.column(1)
        for start in range(0, len(keys), 512):
            for key, text in zip(keys[start : start + 512], column.slice(start, 512).to_pylist()):
                ids.append(key)
                texts.append(text or "")
                held += len(texts[-1])
                if held >= block_bytes:
                    yield ids, texts
                    ids, texts, held = [], [], 0
    if ids:
        yield ids, texts
    del ids, texts
    trim()


def sliced(batches: Iterable[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut into slices that hold ``block_bytes`` of text (column 1) and at most one text more."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = (np.cumsum(size) - size) // block_bytes
        cuts = np.flatnonzero(np.diff(block)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


class Numbers(dict):
    """key -> its number; ``fresh`` has the keys that were new, in order."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self.fresh.append(key)
        found = self[key] = len(self)
        return found

    def of(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def taken(self) -> list[str]:
        fresh, self.fresh = self.fresh, []
        return fresh


def marked_batches(batches: Iterable[pa.RecordBatch], block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list, list[str], pa.Array]]:
    """As ``text_batches``, with column 2 beside them; a block doesn't go beyond its batch."""
    for batch in batches:
        at = 0
        for ids, texts in text_batches([batch.select([0, 1])], block_bytes):
            yield ids, texts, batch.column(2).slice(at, len(ids))
            at += len(ids)


def sorted_groups(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows equal in the first ``n_keys`` columns, from a partition sorted by them.

    Only one run is held at a time.
    """
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_pylist() for i in range(n_keys)]
        rows = list(zip(*keys))
        start = 0
        for i, key in enumerate(rows):
            if key != current:
                if current is not None:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield current, pa.Table.from_batches(held)
                held, start, current = [], i, key
        held.append(batch.slice(start))
    if current is not None:
        yield current, pa.Table.from_batches(held)
    del held
    trim()


def min_labels(linked) -> list[int]:
    """Smallest index reachable, for each row of a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1, initial=n))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def components(ws: Workspace, edges: DataFrame, name: str = "cc", most: int = 60) -> DataFrame:
    """(id, component) for every id in ``edges(a, b)``: the smallest id reachable.

    Alternating large-star and small-star steps. Each takes a minimum per node (combined
    before the shuffle) and a join that the runtime may split, so a node with very many
    neighbours isn't gathered in one task. Every round is a written table.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e: DataFrame) -> DataFrame:
        two = both(e)
        least = two.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return (
            two.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b")
            .union(least.where("m < a").select(F.col("m").alias("a"), F.col("a").alias("b")))
            .where("a <> b").distinct()
        )

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        return (
            down.join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
            .union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
            .distinct()
        )

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1000003)).first())

    now = ws.write(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-0")
    before = None
    for k in range(1, most):
        after = mark(now)
        if after == before or not after[0]:
            break
        before = after
        now = ws.write(small(large(now)), f"{name}-{k}")
        if k > 1:
            ws.drop(f"{name}-{k - 2}")
    else:
        raise RuntimeError("components did not settle")
    ids = now.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))
    roots = now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return ws.write(ids.union(roots), f"{name}-out")
