"""Token ids as Parquet files that can be read selectively.

Documents are dealt to files by ranges of their id and lie in id order. A row holds
doc_id, where the document begins within its file, its length, and its ids as a
dictionary-encoded list; numbers that rise are delta-encoded. Row groups and pages
are small and indexed, so a reader can take the metadata alone, or the pages of a
few documents. A manifest has one row per file with the place of its first id.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import ragged
from .common import Numbers, Workspace, partitions, sliced, trim
from .token_counts import byte_symbols

ROW = "part int, doc_id long, offset long, n_tokens long, ids array<int>"
#: Parts of chunks remembered by a worker before it starts anew.
REMEMBERED = 1_500_000
#: Letters that the library's tables and Python's surely class and lower alike; composing (NFC) leaves them as they are.
SURE = r"^[\x21-\x7eÀ-ÖØ-öø-ÿ]+$"
#: The library's pattern for lower-cased SURE characters, with the ends of lines between chunks.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+|\n").findall


class Rows:
    """Lists of ids, end to end in arrays that grow by doubling."""

    def __init__(self) -> None:
        self.ids, self.at, self.n = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0

    def add(self, lists: list[list[int]]) -> None:
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        ends = self.at[self.n] + np.cumsum(size)
        if not len(ends):
            return
        while len(self.at) <= self.n + len(ends):
            self.at = np.r_[self.at, np.zeros_like(self.at)]
        while len(self.ids) < ends[-1]:
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        self.ids[int(self.at[self.n]) : int(ends[-1])] = np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum()))
        self.at[self.n + 1 : self.n + 1 + len(ends)] = ends
        self.n += len(ends)

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the rows' ids, joined; their lengths)"""
        size = self.at[rows + 1] - self.at[rows]
        return ragged(self.ids, self.at[rows], size), size


def text_encoder(path: str):
    """A function: array of texts -> (the ids of all, joined; how many each has); a null text has none.

    The library drops white space and never joins what it separates, so a text's ids are
    those of its chunks between ASCII white space. A block's different chunks are found by
    Arrow. Plain ones are cut into parts all together, and new parts go straight to the
    library's model; other chunks, also such as hold white space or a special token, go
    through its whole encode.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    symbol = {b: s for s, b in byte_symbols().items()}
    state: dict = {}

    def part(word: str) -> list[int]:
        if word == "\n":
            return []
        if not word.isascii():
            word = "".join(map(symbol.__getitem__, word.encode()))
        return [t.id for t in model.tokenize(word)]

    def plain(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(chunks):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks), "\n")[0].as_py()
        numbers, rows = state["parts"]
        at = numbers.of(PARTS(joined.lower()))
        rows.add([part(w) for w in numbers.taken()])
        ids, size = rows.of(at)
        ends = np.r_[np.flatnonzero(at == numbers["\n"]), len(at)]
        return ids, np.diff(np.r_[0, np.cumsum(size)][np.r_[0, ends]])

    def others(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        numbers, rows = state["others"]
        at = numbers.of(chunks.to_pylist())
        rows.add([tokenizer.encode(c, add_special_tokens=False).ids for c in numbers.taken()])
        return rows.of(at)

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not state or sum(len(numbers) for numbers, _ in state.values()) > REMEMBERED:
            state.update(parts=(Numbers(), Rows()), others=(Numbers(), Rows()))
            state["parts"][0]["\n"]  # the first part, without ids
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        chunks = lists.flatten().dictionary_encode()
        known = chunks.dictionary
        sure = pc.match_substring_regex(known, SURE)
        for s in specials:
            sure = pc.and_not(sure, pc.match_substring(known, s))
        a, size_a = plain(known.filter(sure))
        b, size_b = others(known.filter(pc.invert(sure)))
        sure = sure.to_numpy(zero_copy_only=False)
        size, start = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        size[sure], size[~sure] = size_a, size_b
        start[sure], start[~sure] = np.cumsum(size_a) - size_a, len(a) + np.cumsum(size_b) - size_b
        at = chunks.indices.to_numpy()
        n = size[at]
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return ragged(np.concatenate([a, b]), start[at], n), np.diff(np.r_[0, np.cumsum(n)][bounds])

    return encode


_ENCODERS: dict = {}


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, row_group_bytes: int = 8 << 20, page_bytes: int = 64 << 10) -> None:
    """Write ``out/tokens`` and ``out/manifest``.

    A null or empty text has the end id alone. A null doc_id comes first. Rows that repeat
    an id follow one another, by a hash of their text, so that reruns agree. An empty table
    gives files without rows.
    """
    spark = docs.sparkSession
    n = files or partitions(spark)
    texts = docs.selectExpr(f"CAST({id_col} AS BIGINT) AS doc_id", f"{text_col} AS text")
    texts = texts.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = _ENCODERS.get(path) or _ENCODERS.setdefault(path, text_encoder(path))
        upto = 0
        for block in sliced(batches, 8 << 20):
            found, size = encode(block.column(1))
            found = np.insert(found, np.cumsum(size), end_id)
            size = size + 1
            ends = np.cumsum(size)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(found.view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(size), part, np.int32)), block.column(0), pa.array(upto + ends - size), pa.array(size), lists],
                ["part", "doc_id", "offset", "n_tokens", "ids"],
            )
            upto += int(ends[-1])
        trim()

    options = {
        "compression": "zstd",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.writer.version": "PARQUET_2_0",  # delta encoding where a column has no dictionary
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#offset": "false",
        "parquet.enable.dictionary#n_tokens": "false",
    }
    texts.mapInArrow(run, ROW).write.mode("overwrite").options(**options).parquet(f"{out}/tokens")
    # one row per file: the window over all of them is as long as the list of files
    sizes = spark.read.schema(ROW).parquet(f"{out}/tokens").groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    base = F.coalesce(F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes.withColumn("base", base).coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest")


def read_tokens(spark: SparkSession, out: str, columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the columns asked for.

    Without ``ids`` only the metadata columns are read; a filter on doc_id reaches the
    files' indexes.
    """
    tokens = spark.read.schema(ROW).parquet(f"{out}/tokens")
    manifest = spark.read.parquet(f"{out}/manifest").select("part", "base")
    return tokens.join(manifest, "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", *columns)


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the ids as little-endian unsigned 32-bit."""
    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, ws: Workspace, path: str, end_id: int = 1) -> DataFrame:
    out = f"{ws.path}/files"
    write_tokens(docs, out, path, end_id)
    return checksums(read_tokens(docs.sparkSession, out))
