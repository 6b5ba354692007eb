"""Language identification by a linear-chain conditional random field.

Every word of a text is labelled, so a text may switch between languages. A word's
features are its affixes, its letter n-grams and the languages' lexicons it stands in;
transitions between languages are learnt from sequences spliced together from texts of
different languages. Forward-backward gives each word's marginals; the text's language
has the largest mean.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import remainder, text_batches

#: Rows of each language that are learnt from, at most, with their whole texts.
ROWS = 250
BITS = 18  # hashed features
LEXICON = 300  # most common words of each language
SPLICE = 12  # words between switches, on average, in the sequences learnt from
LENGTH = 40  # words of such a sequence
REMEMBERED = 300_000
LETTER = regex.compile(r"\p{L}")
EDGES = regex.compile(r"^[^\p{L}]+|[^\p{L}]+$")


def words_of(text: str) -> list[str]:
    return [w for w in text.lower().split() if LETTER.search(w)]


def features(word: str, lexicon: dict[str, list[str]]) -> np.ndarray:
    """Hashed affixes, n-grams and lexicon entries of a word."""
    w = EDGES.sub("", word)
    b = f"<{w}>"
    names = ["=" + w]
    names += ["p" + w[:k] for k in (1, 2, 3, 4) if len(w) >= k]
    names += ["s" + w[-k:] for k in (1, 2, 3, 4) if len(w) >= k]
    names += ["g" + b[i : i + k] for k in (2, 3) for i in range(len(b) - k + 1)]
    names += ["L" + x for x in lexicon.get(w, ())]
    return np.array([zlib.crc32(x.encode()) & (1 << BITS) - 1 for x in names], np.int64)


def forward_backward(emit: np.ndarray, move: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Marginals of every word. ``emit`` (words x labels, logs) joins the sequences, longest first.

    All sequences that are long enough take a step together; each step is scaled, so no
    length underflows.
    """
    labels = emit.shape[1]
    weight = np.exp(emit - emit.max(axis=1, keepdims=True)).astype(np.float32)
    trans = np.exp(move - move.max()).astype(np.float32)
    start = np.cumsum(sizes) - sizes
    longest = int(sizes[0]) if len(sizes) else 0
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), side="right")
    ahead = np.empty_like(weight)
    a = weight[start]
    for t in range(longest):
        at = start[: active[t]] + t
        if t:
            a = (a[: active[t]] @ trans) * weight[at]
        a = a / a.sum(axis=1, keepdims=True)
        ahead[at] = a
    back = np.full((len(sizes), labels), 1 / labels, np.float32)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        inner = active[t + 1] if t + 1 < longest else 0
        if inner:
            b = (weight[start[:inner] + t + 1] * back[:inner]) @ trans.T
            back[:inner] = b / b.sum(axis=1, keepdims=True)
        joint = ahead[at] * back[:k]
        ahead[at] = joint / joint.sum(axis=1, keepdims=True)
    return ahead


class Known(dict):
    """word -> place among the words met that have a letter, -1 for others; ``new`` has those not yet scored."""

    def __init__(self):
        super().__init__()
        self.count = 0
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        if LETTER.search(word):
            self[word] = n = self.count
            self.count += 1
            self.new.append(word)
            return n
        self[word] = -1
        return -1


@dataclass
class Field:
    """Languages, feature weights, transitions (logs) and lexicon."""

    languages: list[str]
    weights: np.ndarray
    move: np.ndarray
    lexicon: dict[str, list[str]]


def train(rows: list[tuple[str, str]], epochs: int = 3, rate: float = 0.2, seed: int = 7) -> Field | None:
    """From (language, text) rows; the result depends on their order and the seed alone."""
    rows = [(lang, w) for lang, w in ((lang, words_of(text)) for lang, text in rows) if w]
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    n = len(languages)
    label = {x: i for i, x in enumerate(languages)}
    lexicon: dict[str, list[str]] = {}
    for lang in languages:
        common = Counter(EDGES.sub("", w) for x, ws in rows if x == lang for w in ws)
        for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(w, []).append(lang)
    rng = np.random.default_rng(seed)
    # splice pieces of the texts, in random order, into sequences of one length
    pieces: list[tuple[int, list[str]]] = []
    for lang, ws in rows:
        at = 0
        while at < len(ws):
            size = int(rng.geometric(1 / SPLICE))
            pieces.append((label[lang], ws[at : at + size]))
            at += size
    flat_words, flat_labels = [], []
    for i in rng.permutation(len(pieces)):
        flat_words += pieces[i][1]
        flat_labels += [pieces[i][0]] * len(pieces[i][1])
    cache: dict[str, np.ndarray] = {}
    for w in flat_words:
        if w not in cache:
            cache[w] = features(w, lexicon)
    length = min(LENGTH, len(flat_words))
    count = len(flat_words) // length
    gold = np.array(flat_labels[: count * length]).reshape(count, length)
    weights = np.zeros((1 << BITS, n))
    square = np.full((1 << BITS, n), 1e-2)
    move, move_square = np.zeros((n, n)), np.full((n, n), 1e-2)
    for _ in range(epochs):
        order = rng.permutation(count)
        for lo in range(0, count, 64):
            seqs = order[lo : lo + 64]
            feats = [cache[w] for s in seqs for w in flat_words[s * length : (s + 1) * length]]
            size = np.array([len(f) for f in feats])
            idx = np.concatenate(feats)
            emit = np.add.reduceat(weights[idx], np.cumsum(size) - size)
            y = gold[seqs]
            e = emit.reshape(len(seqs), length, n)
            p = np.exp(e - e.max(axis=2, keepdims=True))
            trans = np.exp(move)
            a = np.empty_like(p)
            b = np.empty_like(p)
            a[:, 0] = p[:, 0] / p[:, 0].sum(axis=1, keepdims=True)
            for t in range(1, length):
                x = (a[:, t - 1] @ trans) * p[:, t]
                a[:, t] = x / x.sum(axis=1, keepdims=True)
            b[:, -1] = 1
            for t in range(length - 2, -1, -1):
                x = (p[:, t + 1] * b[:, t + 1]) @ trans.T
                b[:, t] = x / x.sum(axis=1, keepdims=True)
            mean = a * b
            mean /= mean.sum(axis=2, keepdims=True)
            pair = a[:, :-1, :, None] * trans * (p[:, 1:] * b[:, 1:])[:, :, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            truth = np.zeros_like(mean)
            np.put_along_axis(truth, y[:, :, None], 1, axis=2)
            g = np.repeat((mean - truth).reshape(-1, n), size, axis=0)
            rows_at, place = np.unique(idx, return_inverse=True)
            grad = np.stack([np.bincount(place, g[:, k], len(rows_at)) for k in range(n)], 1) / len(seqs) + 1e-4 * weights[rows_at]
            square[rows_at] += grad**2
            weights[rows_at] -= rate * grad / np.sqrt(square[rows_at])
            gm = pair.sum(axis=(0, 1))
            np.subtract.at(gm, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            gm = gm / len(seqs) + 1e-3 * move
            move_square += gm**2
            move -= rate * gm / np.sqrt(move_square)
    return Field(languages, weights.astype(np.float32), move.astype(np.float32), lexicon)


def learn(docs: DataFrame, per_language: int = ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field | None:
    """A field from the whole texts of at most ``per_language`` different rows of each language.

    Rows are drawn by a hash of their id and text, in its order, and rows that repeat both
    count once: neither a repeated id nor copies crowd out a language, and reruns agree.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("_id", "text", F.lit(3)))
    # a row for each language, as the field itself has weights for each
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return None
    # twice as many as are wanted, so that the count may be rough and the draw uneven
    share = F.create_map(*[F.lit(x) for lang, k in sizes.items() for x in (lang, min(1.0, 2 * per_language / max(k, 1)))])
    point = F.pmod("h", F.lit(1 << 30)) / (1 << 30)
    picked = rows.where(point < F.element_at(share, F.col("lang"))).dropDuplicates(["lang", "h"])
    first = W.partitionBy("lang").orderBy(point, "h")
    got = picked.withColumn("place", F.row_number().over(first)).where(F.col("place") <= per_language).select("lang", "h", "text").collect()
    return train([(r.lang, r.text) for r in sorted(got, key=lambda r: (r.lang, r.h))])


def identify(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the language's mean marginal) for every row.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if
    nothing was learnt. Of languages with equal means the first by name holds.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(field)

    def run(batches):
        model = shared.value
        known, emit = Known(), None
        for ids, whole in text_batches(batches, 12 << 20):
            lang, score = ["und"] * len(ids), np.zeros(len(ids))
            if model:
                if emit is None or len(known) > REMEMBERED:
                    known, emit = Known(), np.zeros((0, len(model.languages)), np.float32)
                seqs = []
                for t in whole:
                    ws = t.lower().split()
                    s = np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))
                    seqs.append(s[s >= 0])
                new, known.new = known.new, []
                if new:
                    fresh = np.empty((len(new), len(model.languages)), np.float32)
                    for lo in range(0, len(new), 20000):
                        feats = [features(w, model.lexicon) for w in new[lo : lo + 20000]]
                        size = np.array([len(f) for f in feats])
                        fresh[lo : lo + 20000] = np.add.reduceat(model.weights[np.concatenate(feats)], np.cumsum(size) - size)
                    emit = np.concatenate([emit, fresh])
                sizes = np.array([len(s) for s in seqs])
                order = np.argsort(-sizes, kind="stable")
                order = order[sizes[order] > 0]
                if len(order):
                    flat = np.concatenate([seqs[i] for i in order])
                    marginal = forward_backward(emit[flat], model.move, sizes[order])
                    mean = np.add.reduceat(marginal.astype(np.float64), np.cumsum(sizes[order]) - sizes[order]) / sizes[order][:, None]
                    best = mean.argmax(axis=1)
                    for i, k, m in zip(order, best, mean):
                        lang[i], score[i] = model.languages[k], min(1.0, float(m[k]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; the rows held out aren't learnt from. A null id isn't held out."""
    out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return identify(docs, learn(docs.where(~out))).select("doc_id", out.alias("held_out"), "lang_pred", "score")
