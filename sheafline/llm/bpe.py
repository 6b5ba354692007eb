"""Byte-level BPE over a global distinct-word shuffle.

Pre-tokens are exploded with their positions by block: a block's documents become
positions into the block's own list of distinct pre-tokens. Only that list is
shuffled, by word and packed, so a word moves at most once per block however common it is.
Each distinct word is encoded once, its ids go back to the blocks that hold it, and
every document is put together again by position. Blocks are written bucketed, so
the documents themselves stay where they are.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbers, Workspace, batch_bytes, partitions, sliced, trim
from .pretokens import BESIDE, pattern_splitter

DIGESTED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values by byte planes, compressed."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] for each pair, joined."""
    if len(lengths) <= 1 << 18:
        ends = np.cumsum(lengths)
        return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
    out = np.empty(int(lengths.sum()), values.dtype)
    done = 0
    for i in range(0, len(lengths), 1 << 18):  # the index arrays stay small
        n = lengths[i : i + (1 << 18)]
        ends = np.cumsum(n)
        total = int(ends[-1])
        out[done : done + total] = values[np.repeat(starts[i : i + (1 << 18)] - (ends - n), n) + np.arange(total)]
        done += total
    return out


def pack_ragged(places: np.ndarray, lengths: np.ndarray, data: bytes) -> bytes:
    """Places, the length of the bytes at each, and the bytes, compressed together."""
    head = np.r_[len(places), len(lengths), places, lengths].astype("<u4").tobytes()
    return zstandard.compress(head + data, 3)


def unpack_ragged(packed: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    raw = zstandard.decompress(packed)
    n, m = np.frombuffer(raw, "<u4", 2).tolist()
    head = np.frombuffer(raw, "<u4", n + m, 8)
    return head[:n], head[n:], raw[8 + 4 * (n + m) :]


def pretokens(texts: pa.Array, split) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct pre-tokens; those of all texts by number, joined; how many each text has); a null text has none.

    As ``Pieces``, but the pieces are found by Arrow, so that a block's texts never are lists of objects.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    numbers = Numbers()
    found, size = array("I"), array("q")

    def learn(piece: str) -> None:
        words = split(piece)
        found.extend(map(numbers.__getitem__, words))
        size.append(len(words))

    whole = np.fromiter((bool(BESIDE.search(t.as_py())) for t in texts), bool, len(texts))
    cut = pc.split_pattern(texts.filter(pa.array(~whole)), " ")
    pieces, bounds = cut.flatten(), cut.offsets.to_numpy() - cut.offsets[0].as_py()
    first = bounds[:-1]
    rest, heads = pieces.dictionary_encode(), pieces.take(pa.array(first)).dictionary_encode()
    at = rest.indices.to_numpy().astype(np.int64)
    at[first] = len(rest.dictionary) + heads.indices.to_numpy()
    used = np.zeros(len(rest.dictionary) + len(heads.dictionary), bool)
    used[at] = True
    for k, piece in enumerate(rest.dictionary):
        learn(" " + piece.as_py()) if used[k] else size.append(0)
    for piece in heads.dictionary:
        learn(piece.as_py())
    for k in np.flatnonzero(whole).tolist():
        learn(texts[k].as_py())
    # a text that is cut has a piece for each space, another one is a piece by itself
    count = np.ones(len(texts), np.int64)
    count[~whole] = np.diff(bounds)
    order = np.empty(int(count.sum()), np.int64)
    own = np.repeat(whole, count)
    order[~own], order[own] = at, len(used) + np.arange(int(whole.sum()))
    words = list(numbers)
    del cut, pieces, rest, heads, at, own, texts, numbers  # what follows needs room of its own
    trim()
    n = np.frombuffer(size, np.int64)
    starts, lengths = np.cumsum(n) - n, n[order]
    sizes = np.diff(np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(count)]])
    return words, ragged(np.frombuffer(found, np.uint32), starts[order], lengths), sizes


def packed_words(words: list[str], place: np.ndarray, buckets: int) -> list[bytes | None]:
    """The words, with their places, by bucket."""
    raw = [w.encode() for w in words]
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    out: list[bytes | None] = []
    for lo, hi in zip(ends, ends[1:]):
        mine = [raw[k] for k in order[lo:hi].tolist()]
        out.append(pack_ragged(place[order[lo:hi]], np.array(list(map(len, mine))), b"".join(mine)) if mine else None)
    return out


def blocks(docs: DataFrame, pattern: str, block_bytes: int, buckets: int) -> DataFrame:
    """A row per block: its documents as places in its list of distinct pre-tokens, and that list by bucket of word."""
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        split = pattern_splitter(pattern)
        for k, block in enumerate(sliced(batches, block_bytes)):
            words, flat, sizes = pretokens(block.column(1), split)
            common = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            place = np.empty(len(common), np.uint32)
            place[common] = np.arange(len(common))
            packed = packed_words(words, place, buckets)
            places = pack(place[flat])
            del words, flat, common, place
            trim()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part + k], pa.int64()),
                    pa.array([block.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([pack(sizes)], pa.binary()),
                    pa.array([places], pa.binary()),
                    pa.array([packed], pa.list_(pa.binary())),
                ],
                ["block", "doc_ids", "lengths", "places", "words"],
            )
            del packed, places

    return docs.mapInArrow(run, "block long, doc_ids array<long>, lengths binary, places binary, words array<binary>")


def reassembled(docs: DataFrame, ws: Workspace, path: str, pattern: str, finish, schema: str, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """What ``finish(doc_ids, pieces, bounds)`` gives for each block, in one Python stage.

    ``pieces(lo, hi)`` has the ids of the block's pre-tokens from lo to hi, and document k those
    from bounds[k] to bounds[k + 1].
    """
    docs = docs.selectExpr(f"CAST({id_col} AS BIGINT) AS doc_id", f"{text_col} AS text")
    spark = docs.sparkSession
    n = partitions(spark)
    with batch_bytes(spark, block_bytes):
        held = ws.write_bucketed(blocks(docs, pattern, block_bytes, 8 * n), "blocks", "block", n)

    def encoded(batches):
        import tiktoken

        one = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={}).encode_ordinary
        last, known = None, {}
        for batch in batches:
            out = []
            for bucket, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if bucket != last:  # all rows of a word are in one bucket
                    last, known = bucket, {}
                _, lengths, data = unpack_ragged(packed)
                found, at = [], 0
                for size in lengths.tolist():
                    word = data[at : at + size]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(one(word.decode()), "<u4").tobytes()
                    found.append(ids)
                    at += size
                out.append(pack_ragged(np.array(list(map(len, found))), np.zeros(0, int), b"".join(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["block", "bucket", "ids"])

    # posexplode_outer: for posexplode the optimizer adds a filter that reads the lists twice
    words = held.select("block", F.posexplode_outer("words").alias("bucket", "packed")).where("packed IS NOT NULL")
    words = words.select("block", "bucket", "packed").repartition(n, "bucket").sortWithinPartitions("bucket")
    back = words.mapInArrow(encoded, "block long, bucket int, ids binary")

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return finish([], lambda lo, hi: np.zeros(0, "<u4"), np.zeros(1, np.int64))
        doc_ids = left.column("doc_ids")[0].as_py()
        bounds = np.r_[0, np.cumsum(unpack(left.column("lengths")[0].as_py()), dtype=np.int64)]
        places = unpack(left.column("places")[0].as_py())
        own = left.column("words")[0]
        flat, size = [], np.zeros(int(places.max()) + 1 if len(places) else 0, np.uint32)
        start, upto = np.zeros(len(size), np.int64), 0
        for bucket, packed in zip(right.column("bucket").to_pylist(), right.column("ids")):
            lengths, _, ids = unpack_ragged(packed.as_py())
            where, n = unpack_ragged(own[bucket].as_py())[0], lengths // 4
            ends = np.cumsum(n, dtype=np.int64)
            size[where], start[where] = n, upto + ends - n
            upto += int(ends[-1])
            flat.append(ids)
        flat = np.frombuffer(b"".join(flat), "<u4")

        def pieces(lo: int, hi: int) -> np.ndarray:
            at = places[lo:hi]
            return ragged(flat, start[at], size[at].astype(np.int64))

        return finish(doc_ids, pieces, bounds)

    left = held.select("block", "doc_ids", "lengths", "places", "words")
    return left.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(reassemble, schema)


def slices(bounds: np.ndarray, most: int = 1 << 18):
    """(first, end) of runs of documents of ``most`` pre-tokens together, or of one that has more."""
    k = 0
    while k + 1 < len(bounds):
        end = max(k + 1, int(np.searchsorted(bounds, bounds[k] + most, side="right")) - 1)
        yield k, end
        k = end


def encode(docs: DataFrame, ws: Workspace, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, ids (array<int>) for every row; a null or empty text has no ids.

    Rows that repeat an id each get a row of their own.
    """
    def lists(doc_ids, pieces, bounds):
        out = []
        for k, end in slices(bounds):
            parts = [pieces(bounds[i], bounds[i + 1]) for i in range(k, end)]
            ends = np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view("<i4")))
            out.append(pa.RecordBatch.from_arrays([pa.array(doc_ids[k:end], pa.int64()), ids], ["doc_id", "ids"]))
        return pa.Table.from_batches(out, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return reassembled(docs, ws, path, pattern, lists, "doc_id long, ids array<int>", id_col, text_col, block_bytes)


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes joined, and where each id's begin."""
    table = sorted((i, b) for b, i in ranks(path).items())
    size = np.zeros(table[-1][0] + 1, np.int64)
    for i, b in table:
        size[i] = len(b)
    return np.frombuffer(b"".join(b for _, b in table), np.uint8), np.r_[0, np.cumsum(size)]


def decoded_batches(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray, rows: int = 128):
    """Batches with the bytes of each id in the table joined in order, a few rows at a time."""
    for part in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
        lists = part.column(1)
        ids = lists.flatten().to_numpy()
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        size = at[ids + 1] - at[ids]
        out = ragged(data, at[ids], size)
        upto = np.r_[0, np.cumsum(size)][offsets]
        raw = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(out)])
        yield pa.RecordBatch.from_arrays([part.column(0), lists, raw], ["doc_id", "ids", "text_bytes"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text_bytes: each id joined with its bytes in the fixed-size table, in order."""
    def run(batches):
        data, at = token_bytes(path)
        for batch in batches:
            yield from decoded_batches(batch, data, at)

    return encoded.mapInArrow(run, "doc_id long, ids array<int>, text_bytes binary")


def round_trip(docs: DataFrame, ws: Workspace, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as ``encode`` and ``decode``, but only digests leave the blocks.

    Ids are decoded and digested a slice of a document at a time.
    """
    def digests(doc_ids, pieces, bounds):
        data, at = token_table(path)
        counts, coded, decoded = [], [], []
        for k in range(len(doc_ids)):
            n, ids_digest, text_digest = 0, hashlib.sha256(), hashlib.sha256()
            for lo in range(bounds[k], bounds[k + 1], 1 << 18):
                ids = pieces(lo, min(lo + (1 << 18), bounds[k + 1]))
                n += len(ids)
                ids_digest.update(ids)
                text_digest.update(ragged(data, at[ids], at[ids + 1] - at[ids]))
            counts.append(n)
            coded.append(ids_digest.hexdigest())
            decoded.append(text_digest.hexdigest())
        columns = [pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
        return pa.Table.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return reassembled(docs, ws, path, pattern, digests, DIGESTED, id_col, text_col, block_bytes)


_TABLES: dict = {}


def token_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """``token_bytes``, read once by a worker."""
    return _TABLES.get(path) or _TABLES.setdefault(path, token_bytes(path))
