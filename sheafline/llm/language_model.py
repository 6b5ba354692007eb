"""Scoring text by a probabilistic suffix tree, beside a smoothed unigram base.

Tokens are A-Z lower-cased words and one end per text. The tree's symbols are the most
common tokens and, for all others, classes by how a word ends. A context of symbols is
kept if it is frequent enough and its next-symbol distribution diverges from its
suffix's; distributions are smoothed towards the suffix's, down to one over all symbols, and
the longest kept suffix of what came before gives a symbol's probability. Within a class a
word has its share of the class's counts; tokens not learnt are one symbol more, with the
share that words seen once show. Probabilities sum to one over the distinct tokens learnt
and that one.

Word counts come from a global shuffle of blocks' distinct words, so a word moves at
most once per block. Everything is counted over all text that is learnt from.
"""

from __future__ import annotations

import copy
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import pack, pack_ragged, unpack, unpack_ragged
from .common import Workspace, partitions, sorted_groups, text_batches

#: Common tokens that are symbols of their own, and classes of the others.
COMMON, CLASSES = 1500, 500
#: Symbols of the longest context, and how often a context is seen at least.
ORDER, LEAST = 3, 10
END = 0  # the symbol of a text's end, which also stands before a text

SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def held_out(doc_id: int | None, folds: int = 10) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


def class_of(word: bytes) -> int:
    """By the last bytes of the word's letters, and whether punctuation follows them."""
    bare = word.rstrip(b".,;:!?\"')")
    return 1 + COMMON + zlib.crc32(bare[-4:] + (b"." if bare != word else b"")) % CLASSES


SYMBOLS = 1 + COMMON + CLASSES


def symbols_of(words: list[bytes], common: dict[bytes, int]) -> np.ndarray:
    return np.array([common.get(w) or class_of(w) for w in words], np.int64)


def blocks(docs: DataFrame, block_bytes: int, folds: int, buckets: int) -> DataFrame:
    """A row per block: its documents as places in its list of distinct words, and that list, with counts, by bucket of word."""
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32

        class Index(dict):
            def __missing__(self, word):
                self[word] = n = len(self)
                return n

        for k, (ids, texts) in enumerate(text_batches(batches, block_bytes)):
            index = Index()
            found = [np.fromiter(map(index.__getitem__, t.encode().lower().split()), np.int64) for t in texts]
            places, lengths = np.concatenate(found), np.array([len(x) for x in found], np.int64)
            learn = np.array([not held_out(i, folds) for i in ids])
            counts = np.bincount(places[np.repeat(learn, lengths)], minlength=len(index))
            often = np.argsort(-np.bincount(places, minlength=len(index)), kind="stable")
            rank = np.empty(len(often), np.int64)
            rank[often] = np.arange(len(often))
            dealt: list[tuple[list[int], list[bytes]]] = [([], []) for _ in range(buckets)]
            for at, word in enumerate(index):
                where = dealt[zlib.crc32(word) % buckets]
                where[0].append(at)
                where[1].append(word)
            packed, n = [], []
            for p, w in dealt:
                packed.append(pack_ragged(rank[p], np.array(list(map(len, w))), b"".join(w)) if p else None)
                n.append(pack(counts[p]) if p else None)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part + k], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([pack(lengths)], pa.binary()),
                    pa.array([pack(rank[places])], pa.binary()), pa.array([packed], pa.list_(pa.binary())), pa.array([n], pa.list_(pa.binary())),
                    pa.array([int(learn.sum())], pa.int64()), pa.array([int(counts.sum())], pa.int64()),
                ],
                ["block", "doc_ids", "lengths", "places", "words", "counts", "learnt", "tokens"],
            )

    return docs.mapInArrow(run, "block long, doc_ids array<long>, lengths binary, places binary, words array<binary>, counts array<binary>, learnt long, tokens long")


FACTS = "distinct long, names array<binary>, counts array<long>, size array<long>, once array<long>"


def facts_batch(distinct: int, top: list[tuple[int, bytes]], size: np.ndarray, once: np.ndarray) -> list[pa.Array]:
    return [
        pa.array([distinct], pa.int64()), pa.array([[w for _, w in top]], pa.list_(pa.binary())), pa.array([[-c for c, _ in top]], pa.list_(pa.int64())),
        pa.array([size], pa.list_(pa.int64())), pa.array([once], pa.list_(pa.int64())),
    ]


def count_words(ws: Workspace, held: DataFrame, n: int) -> tuple[DataFrame, tuple]:
    """((block, packed places and counts of its words), facts).

    The facts are the number of distinct learnt words, the most common ones with their counts,
    and for each class its count and its words seen once. Each task gathers its own in one
    row, and one task adds the rows up as they come.
    """
    def merge(batches):
        distinct, top = 0, []
        size, once = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
        nothing = [pa.nulls(1, f.type) for f in pa.schema([("a", pa.int64()), ("b", pa.list_(pa.binary())), ("c", pa.list_(pa.int64())), ("d", pa.list_(pa.int64())), ("e", pa.list_(pa.int64()))])]
        names = ["block", "packed", "distinct", "names", "counts", "size", "once"]
        for _, group in sorted_groups(batches, 1):
            parts = [(unpack_ragged(w), unpack(c)) for w, c in zip(group.column("packed").to_pylist(), group.column("n").to_pylist())]
            words = []
            for (_, lengths, data), _ in parts:
                at = np.r_[0, np.cumsum(lengths)].tolist()
                words.append([data[a:b] for a, b in zip(at, at[1:])])
            total: dict[bytes, int] = {}
            for own, (_, counts) in zip(words, parts):
                for w, c in zip(own, counts.tolist()):
                    total[w] = total.get(w, 0) + c
            for block, own, ((places, _, _), _) in zip(group.column("block").to_pylist(), words, parts):
                sums = np.array([total[w] for w in own], np.int64)
                packed = pack(np.r_[places, sums & 0xFFFFFFFF, sums >> 32])
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([packed], pa.binary()), *nothing], names)
            learnt = [(-c, w) for w, c in total.items() if c]
            distinct += len(learnt)
            top = heapq.nsmallest(COMMON, [*top, *learnt])
            for c, w in learnt:
                k = class_of(w)
                size[k] -= c
                once[k] += c == -1
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *facts_batch(distinct, top, size, once)], names)

    def add_up(batches):
        distinct, top = 0, []
        size, once = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                distinct += row["distinct"]
                top = heapq.nsmallest(COMMON, [*top, *((-c, w) for w, c in zip(row["names"], row["counts"]))])
                size += np.array(row["size"])
                once += np.array(row["once"])
        yield pa.RecordBatch.from_arrays(facts_batch(distinct, top, size, once), ["distinct", "names", "counts", "size", "once"])

    zipped = held.select("block", F.posexplode_outer(F.arrays_zip("words", "counts")).alias("bucket", "w")).where("w.words IS NOT NULL")
    rows = zipped.select("bucket", "block", F.col("w.words").alias("packed"), F.col("w.counts").alias("n"))
    rows = rows.repartition(n, "bucket").sortWithinPartitions("bucket")
    merged = ws.write(rows.mapInArrow(merge, f"block long, packed binary, {FACTS}"), "counted")
    gathered = merged.where("names IS NOT NULL").select("distinct", "names", "counts", "size", "once").repartition(1)
    return merged.where("block IS NOT NULL").select("block", "packed"), gathered.mapInArrow(add_up, FACTS).first()


def block_words(row: dict) -> tuple[np.ndarray, list[bytes]]:
    """(the block's documents' words as places, the words by place)."""
    words: list[bytes] = []
    order: list[np.ndarray] = []
    for packed in row["words"]:
        if packed is not None:
            places, lengths, data = unpack_ragged(packed)
            at = np.r_[0, np.cumsum(lengths)].tolist()
            words += [data[a:b] for a, b in zip(at, at[1:])]
            order.append(places)
    place = np.empty(len(words), np.int64)
    if words:
        place[np.concatenate(order)] = np.arange(len(words))
    return place[unpack(row["places"]).astype(np.int64)], words


def sequence(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all documents, ORDER ends before each and one after it; where each token is)."""
    upto = np.cumsum(lengths)
    tokens = np.insert(symbols, upto, END)
    document = np.repeat(np.arange(len(lengths)), lengths + 1)
    at = np.arange(len(tokens)) + ORDER * (document + 1)
    out = np.full(len(tokens) + ORDER * len(lengths), END, np.int64)
    out[at] = tokens
    return out, at


def context_keys(seq: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` symbols before each place as one number, the oldest first."""
    key = np.zeros(len(at), np.int64)
    for k in range(depth, 0, -1):
        key = key * SYMBOLS + seq[at - k]
    return key


class SuffixTree:
    """Kept contexts by depth, their counts, and smoothing towards the suffix."""

    def __init__(self, counts: np.ndarray, novel: np.ndarray):
        root = counts + 0.5
        self.root = root / root.sum()
        self.novel = novel  # of each symbol, the share of tokens not learnt
        self.root_unknown = float(self.root @ novel)
        self.levels: list[dict] = []

    def add(self, keys: np.ndarray, context: np.ndarray, symbol: np.ndarray, count: np.ndarray) -> None:
        """The contexts of the next depth, with their next-symbol counts; those that don't diverge are left out."""
        depth = len(self.levels) + 1
        size = np.bincount(context, count, len(keys))
        kinds = np.bincount(context, minlength=len(keys)).astype(float)
        up, up_unknown = self.at(keys, symbol, context, depth - 1)
        own = count / size[context]
        gain = np.bincount(context, count * np.log(own / up), len(keys))
        # twice the gain would be about as large as the distribution's freedoms by chance alone
        kept = gain > 2 * kinds
        new = np.cumsum(kept) - 1
        mine = kept[context]
        unknown = np.bincount(context, count * self.novel[symbol], len(keys))
        mixed = np.divide(unknown + kinds * up_unknown, size + kinds, out=np.zeros(len(keys)), where=kinds > 0)
        entry = new[context[mine]] * SYMBOLS + symbol[mine]
        order = np.argsort(entry)
        self.levels.append({
            "keys": keys[kept], "size": size[kept], "kinds": kinds[kept], "entry": entry[order], "count": count[mine][order].astype(float),
            "unknown": mixed[kept],
        })

    def at(self, keys: np.ndarray, symbol: np.ndarray, context: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each symbol, that of a token not learnt per context) by the suffixes of the contexts up to the depth."""
        p, unknown = self.root[symbol], np.full(len(keys), self.root_unknown)
        for d in range(1, depth + 1):
            p, found = self.step(d, (keys % SYMBOLS**d)[context], symbol, p)
            level = self.levels[d - 1]
            at, hit = locate(level["keys"], keys % SYMBOLS**d)
            unknown = np.where(hit, level["unknown"][at] if len(level["keys"]) else 0, unknown)
        return p, unknown

    def step(self, d: int, keys: np.ndarray, symbol: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        level = self.levels[d - 1]
        at, hit = locate(level["keys"], keys)
        if not hit.any():
            return p, hit
        where, there = locate(level["entry"], at[hit] * SYMBOLS + symbol[hit])
        n = np.where(there, level["count"][where], 0)
        size, kinds = level["size"][at[hit]], level["kinds"][at[hit]]
        p = p.copy()
        p[hit] = (n + kinds * p[hit]) / (size + kinds)
        return p, hit

    def score(self, seq: np.ndarray, at: np.ndarray, unknown: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Log10 probability of the tokens at the places; ``share`` is each one's within its symbol."""
        symbol = seq[at]
        p, u = self.root[symbol], np.full(len(at), self.root_unknown)
        for d in range(1, len(self.levels) + 1):
            keys = context_keys(seq, at, d)
            p, hit = self.step(d, keys, symbol, p)
            if hit.any():
                where, there = locate(self.levels[d - 1]["keys"], keys)
                u = np.where(there, self.levels[d - 1]["unknown"][where], u)
        return np.log10(np.where(unknown, u, p * share))


def locate(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted table, whether it is there) of each key."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def first_level(ws: Workspace, held: DataFrame, tree: SuffixTree, common: dict[bytes, int], size: np.ndarray, least: int, folds: int, n: int) -> None:
    """Add the contexts of one symbol: all learnt text is counted in those seen ``least`` times.

    There are at most as many of them as symbols, each with as many next symbols at most.
    """
    spark = held.sparkSession
    keys = np.flatnonzero(size >= least).astype(np.int64)
    wanted = spark.sparkContext.broadcast((keys, common))

    def count(batches):
        table, names = wanted.value
        for batch in batches:
            for row in batch.to_pylist():
                seq, at, learn = block_sequence(row, names, folds)
                context, hit = locate(table, context_keys(seq, at[learn], 1))
                found, times = np.unique(context[hit] * SYMBOLS + seq[at[learn][hit]], return_counts=True)
                part = found // SYMBOLS % (4 * n)
                order = np.argsort(part, kind="stable")
                found, times, part = found[order], times[order], part[order]
                for p in np.unique(part):
                    lo, hi = np.searchsorted(part, [p, p + 1])
                    gaps = np.diff(np.r_[0, found[lo:hi]])
                    yield pa.RecordBatch.from_arrays([pa.array([int(p)], pa.int32()), pa.array([pack(gaps)]), pa.array([pack(times[lo:hi])])], ["part", "gaps", "times"])

    def total_up(batches):
        for _, group in sorted_groups(batches, 1):
            found = np.concatenate([np.cumsum(unpack(g).astype(np.int64)) for g in group.column("gaps").to_pylist()])
            times = np.concatenate([unpack(t).astype(np.int64) for t in group.column("times").to_pylist()])
            entry, at = np.unique(found, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(entry), pa.array(np.bincount(at, times).astype(np.int64))], ["entry", "n"])

    rows = held.select("doc_ids", "lengths", "places", "words").mapInArrow(count, "part int, gaps binary, times binary")
    counted = rows.repartition(n, "part").sortWithinPartitions("part").mapInArrow(total_up, "entry long, n long")
    got = ws.write(counted, "level-1").toArrow()
    entry, times = got.column("entry").to_numpy(), got.column("n").to_numpy()
    order = np.argsort(entry)
    tree.add(keys, entry[order] // SYMBOLS, entry[order] % SYMBOLS, times[order])


def block_sequence(row: dict, common: dict[bytes, int], folds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of the block's documents, where each token is, whether it is learnt from)."""
    places, words = block_words(row)
    lengths = unpack(row["lengths"]).astype(np.int64)
    seq, at = sequence(symbols_of(words, common)[places] if words else places, lengths)
    learn = np.array([not held_out(i, folds) for i in row["doc_ids"]])
    return seq, at, np.repeat(learn, lengths + 1)


def grams_by_bucket(seq: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct longest contexts with their next symbols, by bucket and value; which one each place has; the bounds of the buckets).

    The bucket is that of the context's last two symbols, so all its suffixes but the shortest are in it.
    """
    found, which = np.unique(context_keys(seq, at, ORDER) * SYMBOLS + seq[at], return_inverse=True)
    pair = (found // SYMBOLS % SYMBOLS**2).astype(np.uint64)
    bucket = (pair * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return found[order], place[which], np.searchsorted(bucket[order], np.arange(buckets + 1))


def grown(tree: SuffixTree, context: np.ndarray, symbol: np.ndarray, count: np.ndarray, least: int) -> SuffixTree:
    """The tree with the longer contexts of these counts that are seen ``least`` times and diverge."""
    out = copy.copy(tree)
    out.levels = list(tree.levels)
    for depth in range(2, ORDER + 1):
        keys, own = np.unique(context % SYMBOLS**depth, return_inverse=True)
        entry, where = np.unique(own * SYMBOLS + symbol, return_inverse=True)
        times = np.bincount(where, count, len(entry)).astype(np.int64)
        often = np.bincount(entry // SYMBOLS, times, len(keys)) >= least
        mine = often[entry // SYMBOLS]
        new = np.cumsum(often) - 1
        out.add(keys[often], new[entry[mine] // SYMBOLS], entry[mine] % SYMBOLS, times[mine])
    return out


def may_be_new(symbol: np.ndarray) -> np.ndarray:
    """Whether a token of the symbol may be one that wasn't learnt: common tokens were."""
    return (symbol > COMMON) | (symbol == END)


def pack_floats(values: np.ndarray) -> bytes:
    return pack(np.ascontiguousarray(values, "<f4").view("<u4"))


def unpack_floats(data: bytes) -> np.ndarray:
    return unpack(data).view("<f4")


def answers(held: DataFrame, shared, least: int, folds: int, n: int, buckets: int) -> DataFrame:
    """block, bucket, probs: probabilities of the block's distinct next symbols in their contexts, and of tokens not learnt where they may come.

    A context's counts and the contexts that ask for it meet in its bucket, so the tree's longer
    contexts grow with the text and no task or driver holds them all.
    """
    def count(batches):
        _, names, _ = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                seq, at, learn = block_sequence(row, names, folds)
                found, which, bounds = grams_by_bucket(seq, at, buckets)
                times = np.bincount(which[learn], minlength=len(found))
                for k in np.flatnonzero(np.diff(bounds)).tolist():
                    lo, hi = bounds[k], bounds[k + 1]
                    gaps = np.diff(np.r_[0, found[lo:hi]])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([pack(np.r_[gaps & 0xFFFFFFFF, gaps >> 32])]), pa.array([pack(times[lo:hi])])],
                        ["bucket", "block", "gaps", "times"],
                    )

    def answer(batches):
        tree, _, _ = shared.value
        for (bucket,), group in sorted_groups(batches, 1):
            parts = []
            for g in group.column("gaps").to_pylist():
                low, high = unpack(g).astype(np.int64).reshape(2, -1)
                parts.append(np.cumsum(low | high << 32))
            times = np.concatenate([unpack(t) for t in group.column("times").to_pylist()])
            found, which = np.unique(np.concatenate(parts), return_inverse=True)
            total = np.bincount(which, times, len(found))
            context, symbol, learnt = found // SYMBOLS, found % SYMBOLS, total > 0
            local = grown(tree, context[learnt], symbol[learnt], total[learnt], least)
            p, unknown = local.at(context, symbol, np.arange(len(found)), ORDER)
            new = may_be_new(symbol)
            ends = np.cumsum([len(x) for x in parts])
            for block, lo, hi in zip(group.column("block").to_pylist(), np.r_[0, ends], ends):
                own = which[lo:hi]
                packed = pack_floats(np.r_[p[own], unknown[own[new[own]]]])
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([packed], pa.binary())], ["block", "bucket", "probs"])

    rows = held.select("block", "doc_ids", "lengths", "places", "words").mapInArrow(count, "bucket int, block long, gaps binary, times binary")
    rows = rows.repartition(n, "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(answer, "block long, bucket int, probs binary")


def score_texts(docs: DataFrame, ws: Workspace, folds: int = 10, least: int = LEAST, block_bytes: int = 10 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Learns from the rows whose crc32(doc_id as text) mod ``folds`` isn't 0; a row without an
    id is learnt from. Null and empty texts have one token, the end. Rows that repeat an
    id each count and each get a row. If nothing is learnt, no token is known.
    """
    docs = docs.selectExpr(f"CAST({id_col} AS BIGINT) AS doc_id", f"{text_col} AS text")
    spark = docs.sparkSession
    n = partitions(spark)
    held = ws.write_bucketed(blocks(docs, block_bytes, folds, 8 * n), "blocks", "block", n)
    counted, facts = count_words(ws, held, n)
    learnt, tokens = (x or 0 for x in held.agg(F.sum("learnt"), F.sum("tokens")).first())
    distinct = facts.distinct
    common = {bytes(w): i for i, w in enumerate(facts.names, 1)}
    size, once = np.array(facts["size"], float), np.array(facts.once, float)
    for w, c in zip(common, facts.counts):  # they are symbols of their own, not of their class
        k = class_of(w)
        size[k] -= c
        once[k] -= c == 1
        size[common[w]] = c
    size[END] = learnt
    whole = size + once
    novel = np.divide(once, whole, out=np.zeros(SYMBOLS), where=whole > 0)
    # a class that nothing was learnt of has nothing but tokens not learnt
    novel[1 + COMMON :][whole[1 + COMMON :] == 0] = 1.0
    total = tokens + learnt
    distinct += learnt > 0
    tree = SuffixTree(size, novel)
    first_level(ws, held, tree, common, size, least, folds, n)
    model = spark.sparkContext.broadcast((tree, common, whole))
    buckets = 2 * n
    answered = answers(held, model, least, folds, n, buckets)
    below = np.log10(total + 0.1 * (distinct + 1))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        if not left.num_rows:
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], columns)
        _, names, mass = model.value
        row = left.to_pylist()[0]
        ids, lengths = row["doc_ids"], unpack(row["lengths"]).astype(np.int64)
        seq, at, _ = block_sequence(row, names, folds)
        raw = unpack(row["places"]).astype(np.int64)
        c = np.zeros(int(raw.max()) + 1 if len(raw) else 0, np.int64)
        found, which, bounds = grams_by_bucket(seq, at, buckets)
        new = may_be_new(found % SYMBOLS)
        known, unknown = np.zeros(len(found)), np.zeros(len(found))
        for packed, bucket, p in zip(*(right.column(x).to_pylist() for x in ("packed", "bucket", "probs"))):
            if packed is not None:
                places, low, high = unpack(packed).astype(np.int64).reshape(3, -1)
                c[places] = low | high << 32
            else:
                lo, hi = bounds[bucket], bounds[bucket + 1]
                values = unpack_floats(p)
                known[lo:hi] = values[: hi - lo]
                unknown[lo:hi][new[lo:hi]] = values[hi - lo :]
        seen = np.insert(c[raw], np.cumsum(lengths), learnt)
        share = np.where(seq[at] > COMMON, seen / np.maximum(mass[seq[at]], 1), 1.0)
        logs = np.log10(np.where(seen == 0, unknown[which], known[which] * share))
        first = np.cumsum(lengths + 1) - (lengths + 1)
        base = np.log10(seen + 0.1) - below
        return pa.Table.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([held_out(i, folds) for i in ids]), pa.array(lengths + 1),
                pa.array(np.add.reduceat((seen > 0).astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(logs, first)),
            ],
            columns,
        )

    left = held.select("block", "doc_ids", "lengths", "places", "words")
    right = counted.select("block", "packed", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("probs")).unionByName(answered.select("block", F.lit(None).cast("binary").alias("packed"), "bucket", "probs"))
    scored = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(score, SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
