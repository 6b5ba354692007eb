"""N-gram Jaccard self-join by chosen paths.

A document is the set of its word 5-grams; documents with one set are a class. Sets
are embedded as minhash values, and each run splits them recursively: a node picks each
coordinate with a probability that lets a pair at the threshold share ``GROWTH`` paths a
level on average, and sets that share the value there go on together. Small nodes are
compared by brute force. In a large one a few members are centres: if nearly all others
are close to them, only the rest is compared with everything, and otherwise the node is
split again, unless all such nodes together are few enough pairs to be compared whole.
Runs repeat until a pair at the threshold is missed with a small probability even at the
deepest level.

Nodes compare bin sketches, whose bounds let pass few pairs that are well below the
threshold. What they link is gathered once with its whole sets, and every pair in it is
decided by its exact Jaccard similarity.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components, marked_batches, min_labels, partitions, small, sorted_groups, text_mark, without

MIX_1, MIX_2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Words a worker remembers the hashes of.
REMEMBERED = 200_000
#: Sets, and n-grams of sets, compared as one block.
BLOCK, GRAMS = 1024, 1 << 19
#: The largest node that is compared at once; centres of a larger one, about, and members that meet them together.
NODE, CENTRES, STAR = 256, 16, 1024
#: Pairs of sketches for each set: nodes that together have no more are compared whole rather than split.
PAIRS = 1024
#: Paths that a pair at the threshold shares a level, on average; above 1, so that deep levels still miss few pairs.
GROWTH = 1.25
#: Bins of the sketch that is compared.
BINS = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = WordHashes()


def shingle_set(text: str, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams, A-Z lower-cased.

    A text of fewer words than n has one n-gram, all its words; one without words has none.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_HASHES) > REMEMBERED:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * STEP + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def coefficients(t: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, t, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, t, np.uint64)


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each coefficient pair, the low 16 bits of the minimum: the high ones are much alike."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 256):
        np.minimum(best, (np.multiply.outer(a, shingles[start : start + 256]) + b[:, None]).min(axis=1), out=best)
    return (best & np.uint64(0xFFFF)).astype("<u2")


def binned(shingles: np.ndarray) -> np.ndarray:
    """A byte of the smallest hash in each of ``BINS`` equal ranges, 0 where there is none."""
    edges = np.arange(BINS, dtype=np.uint64) * np.uint64(2**64 // BINS)
    at = np.searchsorted(shingles, edges)
    some = np.diff(at, append=len(shingles)) > 0
    out = np.zeros(BINS, np.uint8)
    out[some] = shingles[at[some]] % np.uint64(255) + np.uint64(1)
    return out


def close(bins_a: np.ndarray, size_a: np.ndarray, bins_b: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs may be ``threshold`` similar, by their sketches.

    Two bounds on the bins that agree hold for such a pair: one by chance, four standard
    deviations below the mean, and one for certain, as only a smaller hash in its bin
    hides a common one. The second tells nearly exactly for small sets.
    """
    some_a, some_b = bins_a > 0, bins_b > 0
    occupied_a, occupied_b = some_a.sum(axis=1), some_b.sum(axis=1)
    either = occupied_a[:, None] + occupied_b[None, :] - some_a.astype(np.float32) @ some_b.astype(np.float32).T
    same = np.empty(either.shape, np.int32)
    step = max(1, (1 << 20) // max(1, len(bins_b) * BINS))
    for i in range(0, len(bins_a), step):
        same[i : i + step] = ((bins_a[i : i + step, None, :] == bins_b[None, :, :]) & some_a[i : i + step, None, :]).sum(axis=2, dtype=np.int32)
    chance = threshold * either - 4 * np.sqrt(threshold * (1 - threshold) * either)
    hidden = (size_a - occupied_a)[:, None] + (size_b - occupied_b)[None, :]
    sure = (size_a[:, None] + size_b[None, :]) * (threshold / (1 + threshold)) - hidden - 1e-6
    alike = np.minimum(size_a[:, None], size_b[None, :]) >= threshold * np.maximum(size_a[:, None], size_b[None, :]) - 1e-6
    return alike & (same >= chance) & (same >= sure) & (same > 0)


def children(nodes: np.ndarray, owner: np.ndarray, sketches: np.ndarray, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """(next nodes, whose): at each node, the coordinates that it picks, with the owner's values there."""
    if not len(nodes):
        return nodes, owner
    spot = mix(nodes[:, None] + STEP * np.arange(1, sketches.shape[1] + 1, dtype=np.uint64)[None, :])
    at, coordinate = np.nonzero(spot < np.uint64(chance * 2**64))
    return mix(spot[at, coordinate] ^ (sketches[owner[at], coordinate].astype(np.uint64) * MIX_2)), owner[at]


def survival(depth: int, level: float = 1.0) -> float:
    """Chance that a pair follows a common path to the depth, when each node passes it ``level`` times on average."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-level * p)
    return p


def jaccard(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """Exact similarities of all pairs, by products of incidence columns of the shared elements."""
    n_a, n_b = len(sets_a), len(sets_b)
    size_a, size_b = (np.array([len(s) for s in x], np.float64) for x in (sets_a, sets_b))
    flat = np.concatenate([*sets_a, *sets_b])
    row = np.repeat(np.arange(n_a + n_b), [len(s) for s in (*sets_a, *sets_b)])
    _, element, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count[element] > 1)
    both = np.zeros((n_a, n_b))
    if len(shared):
        _, col = np.unique(element[shared], return_inverse=True)
        order = np.argsort(col, kind="stable")
        col, who = col[order], row[shared][order]
        width = 4096
        for start in range(0, int(col[-1]) + 1, width):
            lo, hi = np.searchsorted(col, [start, start + width])
            m = np.zeros((n_a + n_b, width), np.float32)
            m[who[lo:hi], col[lo:hi] - start] = 1
            both += m[:n_a] @ m[n_a:].T
    union = size_a[:, None] + size_b[None, :] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def least_of(label: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row, the smallest id of its component."""
    best = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(best, label, ids)
    return best[label]


_COEFFICIENTS: dict = {}


def spots(reps: np.ndarray, nodes: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    """(rep, node) rows, each once."""
    order = np.lexsort((nodes, owner))
    nodes, owner = nodes[order], owner[order]
    first = np.r_[True, (nodes[1:] != nodes[:-1]) | (owner[1:] != owner[:-1])] if len(nodes) else np.zeros(0, bool)
    return pa.RecordBatch.from_arrays([pa.array(reps[owner[first]]), pa.array(nodes[first].view(np.int64))], ["rep", "node"])


def sketches_of(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<u2").reshape(len(raw), -1)


def unit_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rep, size, bins) of a run of rows, each rep once."""
    rep, first = np.unique(group.column("rep").to_numpy(), return_index=True)
    rows = group.take(pa.array(first))
    return rep, rows.column("size").to_numpy(), np.frombuffer(b"".join(rows.column("bins").to_pylist()), np.uint8).reshape(len(rep), BINS)


def candidates(reps: DataFrame, ws: Workspace, threshold: float, miss: float, sketch: int, depth: int, deepest: int, seed: int) -> DataFrame:
    """(a, b): links that join whatever may be similar, by way of others; not all pairs."""
    n = partitions(reps.sparkSession)
    runs = math.ceil(math.log(miss) / math.log(1 - survival(deepest, GROWTH)))
    chance = GROWTH / (threshold * sketch)

    def roots(batches):
        top = mix(np.arange(1, runs + 1, dtype=np.uint64) * MIX_1 + np.uint64(seed))
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                s, k = sketches_of(part.column(1)), part.num_rows
                at, owner = np.tile(top, k), np.repeat(np.arange(k), runs)
                for _ in range(depth):
                    at, owner = children(at, owner, s, chance)
                yield spots(part.column(0).to_numpy(), at, owner)

    def deeper(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                nodes = part.column(1)
                at = nodes.flatten().to_numpy().view(np.uint64)
                owner = np.repeat(np.arange(part.num_rows), nodes.value_lengths().to_numpy())
                at, owner = children(at, owner, sketches_of(part.column(2)), chance)
                yield spots(part.column(0).to_numpy(), at, owner)

    def star_links(batches):
        for (node, salt), group in sorted_groups(batches, 2):
            rep, size, bins = unit_of(group)
            own = dict(zip(group.column("rep").to_pylist(), zip(group.column("own").to_pylist(), group.column("centre").to_pylist())))
            middle = np.array([own[r][1] for r in rep.tolist()])
            mine = np.array([own[r][0] == salt for r in rep.tolist()])
            label = np.array(min_labels(close(bins[middle], size[middle], bins[middle], size[middle], threshold)))
            near = close(bins[mine], size[mine], bins[middle], size[middle], threshold)
            joined = np.zeros_like(near)
            for c, k in enumerate(label):
                joined[:, k] |= near[:, c]
            labels = [np.flatnonzero(x).tolist() for x in joined]
            heads = rep[middle].tolist()  # a group's first centre stands for it: the others are linked to it
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(int(mine.sum()), node)), pa.array(rep[mine]), pa.array(labels, pa.list_(pa.int32())),
                    pa.array([[heads[c] for c in x] for x in labels], pa.list_(pa.int64())),
                ],
                ["node", "rep", "labels", "heads"],
            )

    def pair_links(batches):
        for _, group in sorted_groups(batches, 3):
            rep, size, bins = unit_of(group)
            near = close(bins, size, bins, size, threshold)
            np.fill_diagonal(near, False)
            touched = near.any(axis=1)
            if touched.any():
                least = least_of(np.array(min_labels(near)), rep)
                keep = touched & (least != rep)
                yield pa.RecordBatch.from_arrays([pa.array(rep[keep]), pa.array(least[keep])], ["a", "b"])

    place = "rep long, node long"
    hashed = F.xxhash64("rep")
    level = ws.write(reps.select("rep", "sketch").mapInArrow(roots, place), f"level-{depth}")
    units: list[DataFrame] = []
    links: list[DataFrame] = []
    crowded = reps.select("rep", "size", "sketch", "bins")
    most_pairs = PAIRS * reps.count()
    for k in range(depth, deepest + 1):
        counts = level.groupBy("node").agg(F.count("*").alias("n"), F.sum(hashed % 1000000007).alias("s"), F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("x")).where("n > 1")
        counts = ws.write(counts, f"nodes-{k}")
        # small nodes with the same members need one comparison; large ones may be split, and then each picks coordinates of its own
        wanted = counts.where(F.col("n") <= NODE).groupBy("n", "s", "x").agg(F.min("node").alias("node")).select("node", "n")
        wanted = wanted.union(counts.where(F.col("n") > NODE).select("node", "n"))
        tagged = ws.write(level.join(wanted, "node").select("node", "n", "rep"), f"members-{k}")
        units.append(tagged.where(F.col("n") <= NODE).select("rep", "node", F.lit(0).alias("mine"), F.lit(1).alias("blocks"), F.lit("own").alias("meets")))
        large = tagged.where(F.col("n") > NODE)
        if large.isEmpty():
            break
        # only what is in large nodes here can be in large nodes further down; a rep's nodes meet one copy of its sketches
        inside = large.groupBy("rep").agg(F.collect_list(F.struct("node", "n")).alias("nodes"))
        crowded = ws.write(crowded.select("rep", "size", "sketch", "bins").join(inside, "rep"), f"crowded-{k}")
        salts = F.ceil(F.col("n") / STAR).cast("int")
        drawn = F.pmod(F.xxhash64("rep", "node", F.lit(seed)), F.col("n")) < CENTRES
        dealt = crowded.select("rep", "size", "bins", F.explode("nodes").alias("at")).select("rep", "size", "bins", "at.node", "at.n")
        dealt = dealt.withColumn("centre", drawn).withColumn("own", F.pmod(hashed, salts).cast("int"))
        dealt = dealt.withColumn("salt", F.explode(F.when(F.col("centre"), F.sequence(F.lit(0), salts - 1)).otherwise(F.array("own"))))
        dealt = dealt.select("node", "salt", "own", "centre", "rep", "size", "bins").repartition(n, "node", "salt").sortWithinPartitions("node", "salt")
        star = ws.write(dealt.mapInArrow(star_links, "node long, rep long, labels array<int>, heads array<long>"), f"star-{k}")
        links.append(star.select(F.col("rep").alias("a"), F.explode("heads").alias("b")).where("a <> b"))
        # the group of centres that most members are close to; the rest is compared with all if it is small
        covers = star.select("node", F.explode("labels").alias("label")).groupBy("node", "label").agg(F.count("*").alias("covered"))
        most = covers.groupBy("node").agg(F.max_by("label", F.struct("covered", "label")).alias("main"), F.max("covered").alias("covered"))
        rest = F.col("n") - F.coalesce("covered", F.lit(0))
        few = rest <= F.least(F.greatest(F.lit(NODE), F.col("n") / 4), F.lit(2 * STAR))
        state = counts.where(F.col("n") > NODE).select("node", "n").join(most, "node", "left").select(F.col("node").alias("at"), "n", "main", few.alias("few"), (rest > 0).alias("some"))
        state = ws.write(state, f"state-{k}")
        known = star.join(state, F.col("node") == F.col("at"))
        blocks = F.ceil(F.col("n") / STAR).cast("int")
        mine = F.pmod(hashed, blocks).cast("int").alias("mine")
        # where none is left over, the centres have linked all members to one another
        meets = F.when(F.array_contains("labels", F.col("main")), "own").otherwise("each")
        units.append(known.where("few AND some").select("rep", "node", mine, blocks.alias("blocks"), meets.alias("meets")))
        pairs = state.where("not few").agg(F.sum(F.col("n") * (F.col("n") - 1.0) / 2)).first()[0] or 0
        if k == deepest or pairs <= most_pairs:
            # a level costs some ten shuffles, however little is left
            units.append(known.where("not few").select("rep", "node", mine, blocks.alias("blocks"), F.lit("pairs").alias("meets")))
            break
        # a rep's nodes, a few for each run, go on beside one copy of its sketch
        split = known.where("not few").groupBy("rep").agg(F.collect_list("node").alias("nodes"))
        split = split.join(crowded.select("rep", "sketch"), "rep").select("rep", "nodes", "sketch")
        level = ws.write(split.mapInArrow(deeper, place), f"level-{k + 1}")
    # as above, a rep's nodes meet one copy of its sketch; only then are they dealt to the blocks of each node
    listed = reduce(DataFrame.union, units).groupBy("rep").agg(F.collect_list(F.struct("node", "mine", "blocks", "meets")).alias("nodes"))
    members = listed.join(reps.select("rep", "size", "bins"), "rep").select("rep", "size", "bins", F.explode("nodes").alias("at")).select("rep", "size", "bins", "at.*")
    members = members.withColumn("other", F.explode(F.when(F.col("meets") == "own", F.array("mine")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    first = F.when(F.col("meets") == "pairs", F.col("mine")).otherwise(F.col("other"))
    members = members.withColumn("i", F.least(first, "other")).withColumn("j", F.greatest(first, "other"))
    members = members.select("node", "i", "j", "rep", "size", "bins").repartition(n, "node", "i", "j").sortWithinPartitions("node", "i", "j")
    found = members.mapInArrow(pair_links, "a long, b long")
    return ws.write(reduce(DataFrame.union, links, found).distinct(), "linked")


def verified(wanted: DataFrame, ws: Workspace, threshold: float, shingle: int) -> DataFrame:
    """(rep, links, least, alone) for rows (digest, text, rep, component, blocks, copies) of candidate components.

    All pairs of a component are decided by their whole sets, block against block. ``links``
    counts rows linked in one pair of blocks, ``least`` is the smallest rep that they
    reach there, and ``alone`` says that the component is a single block, so that it is final.
    """
    def whole_sets(batches):
        for batch in batches:
            for part in (batch.slice(s, 256) for s in range(0, batch.num_rows, 256)):
                sets = [shingle_set(t or "", shingle) for t in part.column("text").to_pylist()]
                # of an id that stands for several texts, this class's alone
                own = pa.array([set_digest(s) == d for s, d in zip(sets, part.column("digest").to_pylist())])
                out = pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in sets], pa.binary()), *part.columns[2:]], ["shingles", *part.schema.names[2:]])
                yield out.filter(own)

    kinds = "shingles binary, rep long, component long, blocks int, copies long"
    sets = wanted.select("digest", "text", "rep", "component", "blocks", "copies").mapInArrow(whole_sets, kinds)
    sets = sets.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    key = ["component", "i", "j"]
    sets = sets.select(*key, "mine", "blocks", "rep", "copies", "shingles").repartition(partitions(wanted.sparkSession), *key).sortWithinPartitions(*key, "rep")

    def exact_links(batches):
        for (_, i, j), group in sorted_groups(batches, 3):
            rep, copies, mine = (group.column(c).to_numpy() for c in ("rep", "copies", "mine"))
            found = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
            # a row that is repeated as a whole counts once: its class has the copies
            once = np.r_[True, rep[1:] != rep[:-1]]
            a = np.flatnonzero(once & (mine == i))
            b = np.flatnonzero(once & (mine == j))
            near = jaccard([found[k] for k in a], [found[k] for k in b]) >= threshold if len(a) and len(b) else np.zeros((len(a), len(b)), bool)
            if i == j:
                np.fill_diagonal(near, False)
                ids, got, graph = rep[a], near @ copies[a], near
            else:
                ids = np.r_[rep[a], rep[b]]
                got = np.r_[near @ copies[b], near.T @ copies[a]]
                graph = np.zeros((len(ids), len(ids)), bool)
                graph[: len(a), len(a) :] = near
                graph |= graph.T
            touched = graph.any(axis=1) if len(ids) else np.zeros(0, bool)
            if touched.any():
                least = least_of(np.array(min_labels(graph)), ids)
                alone = group.column("blocks")[0].as_py() == 1
                columns = [pa.array(ids[touched]), pa.array(got[touched].astype(np.int64)), pa.array(least[touched]), pa.array(np.full(int(touched.sum()), alone))]
                yield pa.RecordBatch.from_arrays(columns, ["rep", "links", "least", "alone"])

    return ws.write(sets.mapInArrow(exact_links, "rep long, links long, least long, alone boolean"), "links")


def set_digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes()) + len(shingles).to_bytes(4, "little")


def near_rows(
    docs: DataFrame, ws: Workspace, threshold: float = 0.8, shingle: int = 5, miss: float = 1e-3, sketch: int = 64,
    depth: int = 2, deepest: int = 8, seed: int = 1, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, mark, class_id, n_links, class_size, kept for every row; ``mark`` is a hash of the text.

    ``n_links`` counts the other rows whose n-gram set is at least ``threshold`` similar,
    copies included; ``class_id`` is the smallest doc_id reachable by links and the row that
    stays. Null, empty and wordless texts link with nothing, and so do rows without an id.
    Rows that repeat an id and a text are copies of one another; rows that repeat an id with
    other texts each have their own class. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sketched(batches):
        a, b = _COEFFICIENTS.get((sketch, seed)) or _COEFFICIENTS.setdefault((sketch, seed), coefficients(sketch, seed))
        for ids, whole, marks in marked_batches(batches):
            sets = [s if i is not None else s[:0] for i, s in zip(ids, (shingle_set(t, shingle) for t in whole))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), marks,
                    pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([minhash(s, a, b).tobytes() if len(s) else None for s in sets], pa.binary()),
                    pa.array([binned(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "mark", "digest", "size", "sketch", "bins"],
            )

    known = texts.select("doc_id", "text", text_mark(F.col("text")).alias("mark"))
    known = ws.write(known.mapInArrow(sketched, "doc_id long, mark long, digest binary, size long, sketch binary, bins binary"), "sketches")
    classes = known.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.any_value("size").alias("size"), F.any_value("sketch").alias("sketch"), F.any_value("bins").alias("bins")
    )
    # numbers of the written classes stand for them from here on
    reps = ws.write(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    maybe = components(ws, candidates(reps, ws, threshold, miss, sketch, depth, deepest, seed), "maybe")
    members = ws.write(maybe.withColumnRenamed("id", "rep").join(reps.select("rep", "digest", "first_id", "copies", "size"), "rep"), "maybe-members")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / GRAMS)).cast("int")
    chosen = ws.write(members.join(members.groupBy("component").agg(blocks.alias("blocks")), "component"), "chosen")
    # the list is narrow: while it is short it goes to the texts, and only texts of candidates move
    links = verified(texts.join(small(chosen), F.col("doc_id") == F.col("first_id")), ws, threshold, shingle)
    merged = components(ws, links.where("not alone").select(F.col("rep").alias("a"), F.col("least").alias("b")), "classes-of")
    merged = merged.union(links.where("alone").select(F.col("rep").alias("id"), F.col("least").alias("component"))).withColumnRenamed("id", "rep")
    linked = links.groupBy("rep").agg(F.sum("links").alias("links")).join(merged, "rep").join(reps.select("rep", "digest", "first_id", "copies"), "rep")
    linked = ws.write(linked, "linked-classes")
    totals = linked.groupBy("component").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    found = linked.join(totals, "component").select("digest", "class_id", "class_size", "links")
    own = reps.select("digest", "first_id", "copies").join(found, "digest", "left")
    own = own.select(
        "digest", F.coalesce("class_id", "first_id").alias("class_id"), F.coalesce("class_size", "copies").alias("class_size"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    out = known.select("doc_id", "mark", "digest").join(own, "digest", "left")
    class_id = F.coalesce("class_id", "doc_id")
    return out.select(
        "doc_id", "mark", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"),
    )


def near_documents(docs: DataFrame, ws: Workspace, **options) -> DataFrame:
    """doc_id, class_id, n_links, class_size, kept for every row: as ``near_rows``, without the mark."""
    return near_rows(docs, ws, **options).drop("mark")


def one_of_each(docs: DataFrame, ws: Workspace) -> DataFrame:
    """The rows of ``docs`` but for those that a near copy stands for, with all their columns.

    Rows that repeat an id are told apart by their text; rows that repeat both stay or go together.
    """
    inner = ws.inner("groups")
    kept = without(docs, ws, near_rows(docs, inner).where("not kept"))
    inner.clear()
    return kept
