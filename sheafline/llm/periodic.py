"""Periodic runs of words: stretches that repeat with one period several times over.

For every lag, the pairs of equal words at that distance are counted: words that are
frequent in a text by the autocorrelation of their places (a Fourier transform, rounded to
whole numbers), rare ones by the differences of their places. Only a lag with as many
matches as a run needs is looked at further: first at places one lag apart, of which a run
holds several in a row, then all along for islands of matches. Texts are taken in blocks,
each step over all the texts of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, ship, trim

#: Characters of a block; a longer text is a block of its own.
BLOCK = 4 << 20
#: A word is frequent if pairing its places would cost more than a transform: by this times sqrt(n log n).
HEAVY = 0.7
SPACE = r"[\x20\x09-\x0D]+"


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(a number for each word, the words by number, where each text's words begin)."""
    lists = pc.split_pattern_regex(pc.fill_null(texts, ""), SPACE)
    flat = lists.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.concatenate([[0], real]))
    offsets = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, offsets


def heavy_counts(places: list[np.ndarray], n: int, lags: int) -> np.ndarray:
    """How many pairs of equal words are each lag apart, for words given by their places."""
    size = 1 << int(2 * n - 1).bit_length()
    power = np.zeros(size // 2 + 1)
    for at in places:
        x = np.zeros(size)
        x[at] = 1
        power += np.abs(np.fft.rfft(x)) ** 2
    return np.rint(np.fft.irfft(power, size)[: lags + 1]).astype(np.int64)


def lag_counts(codes: np.ndarray, offsets: np.ndarray, times: int, heavy: float = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """(matches, base): text t has ``matches[base[t] + q]`` pairs of equal words q apart, up to its words / ``times``."""
    lengths = np.diff(offsets)
    lags = lengths // times
    base = np.concatenate([[0], np.cumsum(lags + 1)])
    counts = np.zeros(base[-1], np.int64)
    text = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((codes, text)) if len(codes) else np.zeros(0, np.int64)
    c, t = codes[order], text[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(c)))
    end = np.repeat(first + size, size)  # where a word's places in its text end
    limit = heavy * np.sqrt(lengths * np.log2(np.maximum(lengths, 2)))
    many = np.flatnonzero(size > np.maximum(limit[t[first]], 16)) if len(first) else first
    light = np.ones(len(c), bool)
    by_text: dict[int, list[np.ndarray]] = {}
    for g in many.tolist():
        s = slice(first[g], first[g] + size[g])
        light[s] = False
        by_text.setdefault(int(t[first[g]]), []).append(order[s] - offsets[t[first[g]]])
    for k, places in by_text.items():
        counts[base[k] : base[k + 1]] += heavy_counts(places, int(lengths[k]), int(lags[k]))
    # of the others, places one, two, ... occurrences on, as long as they are within the largest lag
    left, step = np.flatnonzero(light), 1
    while len(left):
        left = left[left + step < end[left]]
        apart = order[left + step] - order[left]
        near = apart <= lags[t[left]]
        left, apart = left[near], apart[near]
        counts += np.bincount(base[t[left]] + apart, minlength=len(counts)) if len(left) > len(counts) // 8 else _added(len(counts), base[t[left]] + apart)
        step += 1
    return counts, base


def _added(n: int, at: np.ndarray) -> np.ndarray | int:
    """Counts of few places."""
    if not len(at):
        return 0
    out = np.zeros(n, np.int64)
    np.add.at(out, at, 1)
    return out


def divisors(q: int) -> list[int]:
    """q over each of its prime factors: a stretch with a smaller period that divides q has one of these."""
    out, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            out.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return [*out, q // rest] if rest > 1 else out


def runs_at(codes: np.ndarray, q: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, q) of the runs with smallest period q."""
    same = np.concatenate([[False], codes[q:] == codes[:-q], [False]]).astype(np.int8)
    turns = np.diff(same)
    starts, stops = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    long = stops - starts + q >= max(least, times * q)
    for s, e in zip(starts[long].tolist(), stops[long].tolist()):
        part = codes[s : e + q]
        if not any((part[g:] == part[:-g]).all() for g in divisors(q)):
            yield s, e + q - s, q


def find_runs(codes: np.ndarray, offsets: np.ndarray, least: int = 6, times: int = 4, heavy: float = HEAVY) -> list[list[tuple[int, int, int]]]:
    """The runs of each text by start and period; a period needs ``times`` repetitions, and a run ``least`` words."""
    counts, base = lag_counts(codes, offsets, times, heavy)
    lag = np.arange(len(counts)) - np.repeat(base[:-1], np.diff(base))
    need = np.maximum(least - lag, (times - 1) * lag)
    hits = np.flatnonzero((lag > 0) & (counts >= need))
    text = np.searchsorted(base, hits, "right") - 1
    lengths = np.diff(offsets)
    found: list[list[tuple[int, int, int]]] = [[] for _ in lengths]
    # a run holds times - 1 places in a row that are a lag apart and match the next, wherever it begins
    q = lag[hits]
    steps = np.maximum((lengths[text] - 1) // np.maximum(q, 1), 0)
    for lo, hi in _parts(steps, 1 << 22):
        n = steps[lo:hi]
        which = np.repeat(np.arange(lo, hi), n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = offsets[text[which]] + j * q[which]
        match = codes[at] == codes[at + q[which]]
        match &= (j + 1) * q[which] < lengths[text[which]]
        ok = match.copy()
        for k in range(1, times - 1):
            ok[:-k] &= match[k:] & (which[k:] == which[:-k])
            ok[-k:] = False
        for h in np.unique(which[ok]).tolist():
            k = int(text[h])
            found[k] += runs_at(codes[offsets[k] : offsets[k + 1]], int(q[h]), least, times)
    for r in found:
        r.sort(key=lambda x: (x[0], x[2]))
    return found


def _parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges whose sizes add up to about ``most`` each."""
    total = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + most, "right")))
        yield lo, hi
        lo = hi


def collapsed(runs: list[list[tuple[int, int, int]]], offsets: np.ndarray) -> np.ndarray:
    """Whether each word stays: those of a run after its first period go."""
    change = np.zeros(offsets[-1] + 1, np.int64)
    for k, found in enumerate(runs):
        for s, length, q in found:
            change[offsets[k] + s + q] += 1
            change[offsets[k] + s + length] -= 1
    return np.cumsum(change[:-1]) == 0


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of ``most`` bytes of text or so, at least one row."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


RUN = "struct<start:bigint,length:bigint,period:bigint>"


def periodic_runs(docs: DataFrame, text: Column, least: int = 6, times: int = 4, block: int = BLOCK, heavy: float = HEAVY, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, runs (by start, then period), collapsed (the words that stay, joined by one space).

    Words are separated by ASCII space and the characters 9 to 13. A run is a stretch of
    words with smallest period q, of at least ``times`` * q and ``least`` words, that can't
    be made longer with period q. Of each run only the first period stays. Null and empty
    texts have no words and no runs, and collapse to ''. Every row is taken by itself, so
    rows may repeat; the id may be null. A text is never split, so that a task holds one
    block of texts, or one text.
    """
    ship(docs.sparkSession)

    def run(batches):
        for part in blocks(batches, block):
            codes, words, offsets = words_of(part.column(1))
            runs = find_runs(codes, offsets, least, times, heavy)
            stay = collapsed(runs, offsets)
            kept = np.concatenate([[0], np.cumsum(stay)])[offsets]
            lists = pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), words.take(pa.array(codes[stay])))
            # columns, as rows of Python objects would be slow
            flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
            ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
            each = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(ends), each), pc.binary_join(lists, " ").cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def repeated(text: Column, mark: Column) -> Column:
    """The text, or for a ``mark`` (unsigned) divisible by 10 its words with those from one on repeated, up to its length.

    Word i from a = g % n on becomes word a + (i - a) % p, where g = floor(mark / 10) and
    p = 1 + floor((n - a) / (3 + g % 8)).
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, g = F.size(words), F.floor(mark / 10)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    period = F.slice(words, a + 1, p)
    again = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), again), " ")
    return F.when((mark % 10 == 0) & (n > 0), made).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """The columns of a report on ``periodic_runs``: the run with the greatest exponent, and digests."""
    best = F.aggregate(
        "runs", F.lit(None).cast(RUN),
        # greater if length / period is; the first of equal ones stays, as runs are in order
        lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b),
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return told.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    mark = F.crc32(F.col("doc_id").cast("string"))
    return digests(periodic_runs(docs, repeated(F.col("text"), mark)))
