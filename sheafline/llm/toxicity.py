"""Toxicity by weak supervision.

Words, word beginnings, and beginnings that a text is dense with become voters: those that
go with toxic labels for them, others that go with clean ones against. A generative label model estimates each voter's accuracy from
how the votes agree, with voters that correlate within a class taken as one, and
gives every sampled document a posterior. A linear classifier learns the posteriors
from lexicon and pattern features and scores every document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import marked_batches, min_labels, remainder, ship, text_batches, text_mark

#: Labelled rows that are learnt from at most: those with the smallest hashes of their id.
SAMPLE = 20_000
#: Voters for and against, and features of the classifier, at most.
FOR, AGAINST, FEATURES = 96, 16, 1000
#: A text is dense with a beginning if two of its words or more have it, and this share of all.
DENSE = 0.01
#: Predicted toxic from this score on.
CUT = 0.7
#: Decays of the classifier; training rows decide.
DECAYS = (1e-5, 1e-4, 1e-3)
SUPPORT = 5  # documents that a feature needs
PURE = 30  # times as common in toxic documents as in others, for a voter
PREFIXES = (3, 4, 5, 6)
EDGES = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
STRETCHED = regex.compile(r"(\p{L})\1\1")
REMEMBERED = 300_000


def word_features(raw: str) -> tuple[str, ...]:
    """Of a word as it stands: itself and its beginnings, without case or punctuation at its ends, and how it is written."""
    word = EDGES.sub("", raw.lower())
    if not word:
        return ("#exclaims",) if "!" in raw else ()
    out = ["=" + word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]
    if "!" in raw:
        out.append("#exclaims")
    if len(word) >= 4 and raw.isupper():
        out.append("#shouts")
    if STRETCHED.search(word):
        out.append("#stretches")
    return tuple(out)


def present(text: str, found) -> set:
    """Features of a text; ``found`` gives a word's (features, those of them that may be dense with their names), or nothing."""
    words = Counter(text.split())
    out, forms, times = set(), Counter(), Counter()
    for word, n in words.items():
        if got := found(word):
            out.update(got[0])
            for f in got[1]:
                forms[f] += 1
                times[f] += n
    least = DENSE * words.total()
    out.update(f for f, n in forms.items() if n > 1 and times[f] >= least)
    return out


def dense(feature: str) -> str:
    return "*" + feature


class All(dict):
    """word -> (its features, names of what a text may be dense with)."""

    def __missing__(self, raw: str) -> tuple:
        names = word_features(raw)
        if len(self) > REMEMBERED // 4:
            self.clear()
        found = self[raw] = (names, tuple(dense(f) for f in names if f[0] == "^"))
        return found


class Features(dict):
    """word -> indices of its features among the chosen ones, and of what a text may be dense with; None if there are none."""

    def __init__(self, names: list[str]):
        super().__init__()
        self.at = {f: i for i, f in enumerate(names)}

    def __missing__(self, raw: str) -> tuple | None:
        names = word_features(raw)
        one, many = ([i for i in map(self.at.get, x) if i is not None] for x in (names, map(dense, names)))
        found = self[raw] = (one, many) if one or many else None
        return found

    def of(self, text: str) -> list[int]:
        if len(self) > REMEMBERED:
            self.clear()
        return sorted(present(text, self.__getitem__))


def cover(rows: list[set[int]], candidates: list[int], most: int, least: int = 2) -> list[int]:
    """Of the candidates, those that in turn add the most rows that too few of the chosen ones speak for.

    A row is spoken for by two, so that voters overlap and their agreement tells of them.
    """
    wanted = set(candidates)
    need = [2] * len(rows)
    at: dict[int, list[int]] = {c: [] for c in candidates}
    for i, r in enumerate(rows):
        for f in r & wanted:
            at[f].append(i)
    gain = {c: len(x) for c, x in at.items()}
    chosen: list[int] = []
    while gain and len(chosen) < most:
        best = max(gain, key=lambda c: (gain[c], -c))
        if gain.pop(best) < least:
            break
        chosen.append(best)
        for i in at[best]:
            need[i] -= 1
            if need[i] == 0:
                for f in rows[i] & gain.keys():
                    gain[f] -= 1
    return chosen


@dataclass
class LabelModel:
    """P(vote | class) for groups of voters; a group votes if any of its voters does."""

    prior: float
    fires: np.ndarray  # 2 x groups
    groups: np.ndarray  # of each voter
    abstain: bool = False

    def collapsed(self, votes: np.ndarray) -> np.ndarray:
        return collapse(votes, self.groups)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return given(self.collapsed(votes), self.fires, self.prior, self.abstain)


def collapse(votes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    out = np.zeros((len(votes), int(groups.max()) + 1))
    for j, g in enumerate(groups):
        np.maximum(out[:, g], votes[:, j], out=out[:, g])
    return out


def given(votes: np.ndarray, fires: np.ndarray, prior: float, abstain: bool) -> np.ndarray:
    """Posterior by all voters, or by those that fire: where each language has its own, the silence of others tells nothing."""
    on, off = np.log(fires), np.log1p(-fires)
    z = votes @ (on[1] - on[0]) + np.log(prior / (1 - prior))
    if not abstain:
        z += (1 - votes) @ (off[1] - off[0])
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def correlations(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Largest correlation of each pair of voters within a class."""
    out = np.zeros((votes.shape[1], votes.shape[1]))
    for share in (q, 1 - q):
        total = max(share.sum(), 1e-9)
        mean = share @ votes / total
        cov = (votes * share[:, None]).T @ votes / total - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        out = np.maximum(out, np.where((total > 30) & (np.outer(sd, sd) > 1e-6), cov / np.outer(sd, sd), 0))
    np.fill_diagonal(out, 0)
    return out


def fit_label_model(votes: np.ndarray, side: np.ndarray, prior: float, clean: np.ndarray | None = None, abstain: bool = False, together: float = 0.5, rounds: int = 3, steps: int = 25) -> LabelModel:
    """Expectation maximisation over votes (documents x voters, 0 or 1).

    ``side`` is 1 for voters for the class and 0 for those against; it only says where to begin.
    The prior is held if silent voters abstain. ``clean``, if given, marks documents known not to be in the class: the
    rates at which voters for it fire on them are held firmly, which anchors voters that
    never meet another. After each round voters
    whose votes correlate within a class beyond ``together`` become one group, which votes if
    any of them does, so that they aren't counted as many.
    """
    n, m = votes.shape
    groups = np.arange(m)
    q = np.where(votes @ (2.0 * side - 1) > 0, 0.95, prior / 4)
    for _ in range(rounds):
        v = collapse(votes, groups)
        ours = collapse(side[None, :], groups)[0] == 1
        quiet = None if clean is None else (v[clean].sum(axis=0) + 0.05) / (clean.sum() + 1)
        for _ in range(steps):
            mass = np.array([(1 - q).sum(), q.sum()])
            fires = (np.stack([(1 - q) @ v, q @ v]) + 0.05) / (mass[:, None] + 1)
            if quiet is not None:
                fires[0] = np.where(ours, quiet, fires[0])
            # a voter never turns against its side
            lo, hi = np.minimum(fires[0], fires[1]), np.maximum(fires[0], fires[1])
            fires = np.clip(np.where(ours, np.stack([lo, hi]), np.stack([hi, lo])), 1e-6, 1 - 1e-6)
            share = prior if abstain else float(np.clip(mass[1] / n, 1e-4, 0.5))
            q = given(v, fires, share, abstain)
        model = LabelModel(share, fires, groups, abstain)
        linked = (correlations(votes, q) > together) & (side[:, None] == side[None, :])
        label = np.array(min_labels(linked))
        new = np.unique(label, return_inverse=True)[1]
        if (new == groups).all():
            break
        groups = new
    return model


def fit_linear(rows: list[list[int]], target: np.ndarray, size: int, decay: float = 1e-6, steps: int = 500, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Adam over all rows."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([np.array(r, np.int64) for r in rows]) if len(at) else np.zeros(0, np.int64)
    w = np.zeros(size + 1)
    w[size] = np.log((target.mean() + 1e-6) / (1 - target.mean() + 1e-6))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = np.bincount(at, w[col], len(rows)) + w[size]
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / len(rows)
        g = np.r_[np.bincount(col, err[at], size) + decay * w[:size], err.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:size], float(w[size])


def fit_best(rows: list[list[int]], targets: list[np.ndarray], gold: np.ndarray, size: int, cut: float, most: int = 6000) -> tuple[np.ndarray, float]:
    """``fit_linear`` for the targets and decay that do best on the gold labels of a fourth of ``most`` rows, learnt from the others.

    That is the fewest errors at the cut, then the likeliest labels.
    """
    tried = range(min(most, len(rows)))
    some, test = [rows[i] for i in tried if i % 4], [rows[i] for i in tried if not i % 4]
    y, found = gold[: len(tried)][::4], []
    for k, target in enumerate(targets):
        for decay in DECAYS:
            w, b = fit_linear(some, target[[i for i in tried if i % 4]], size, decay, 200)
            z = np.array([w[r].sum() + b for r in test])
            found.append((int(((z >= np.log(cut / (1 - cut))) != y).sum()), float(np.logaddexp(0, np.where(y == 1, -z, z)).mean()), k, decay))
    _, _, k, decay = min(found)
    return fit_linear(rows, targets[k], size, decay)


@dataclass
class Classifier:
    names: list[str]
    weights: np.ndarray
    bias: float


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", cut: float = CUT) -> Classifier | None:
    """None if there are no labelled rows of both kinds.

    ``labels`` has rows (doc_id, toxic); of rows that repeat an id the higher label holds,
    and rows without an id or label are passed over. At most ``sample`` of them are used.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("y")).where("_id IS NOT NULL AND y IS NOT NULL")
    chosen = marked.groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # the sample is bounded, so it may be broadcast and the documents stay in place
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"))
    taught = texts.join(F.broadcast(chosen), "_id").select("y", "text")

    def count(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        rows = Counter()
        names = All()

        def out():
            listed = list(seen[0].keys() | seen[1].keys())
            listed.append("")
            cols = [[seen[y][f] for f in listed[:-1]] + [rows[y]] for y in (1, 0)]
            return pa.RecordBatch.from_arrays([pa.array(listed, pa.string()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], ["f", "pos", "neg"])

        for ys, whole in text_batches(batches):
            for y, text in zip(ys, whole):
                rows[y] += 1
                seen[y].update(present(text, names.__getitem__))
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield out()
                seen, rows = {0: Counter(), 1: Counter()}, Counter()
        yield out()

    counted = taught.mapInArrow(count, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals = counted.where("f = ''").first()
    if totals is None or not totals.pos or not totals.neg:
        return None
    n_pos, n_neg = totals.pos, totals.neg
    # twice the log likelihood ratio against independence of the label, with the sign of the association
    def part(k, n, of):
        return F.when(k > 0, k * F.log(k / (n * of))).otherwise(0.0)

    pos, neg, rows_all = F.col("pos"), F.col("neg"), n_pos + n_neg
    with_it, without_it = pos + neg, F.lit(rows_all) - pos - neg
    gain = part(pos, with_it, n_pos / rows_all) + part(neg, with_it, n_neg / rows_all)
    gain += part(n_pos - pos, without_it, n_pos / rows_all) + part(n_neg - neg, without_it, n_neg / rows_all)
    score = F.when(pos * n_neg > neg * n_pos, 2 * gain).otherwise(-2 * gain)
    ranked = counted.where((F.col("f") != "") & (F.col("pos") + F.col("neg") >= SUPPORT)).select("f", "pos", "neg", score.alias("z"))
    top = ranked.orderBy(F.abs("z").desc(), "f").limit(FEATURES).collect()
    names = [r.f for r in top]
    pro = [i for i, r in enumerate(top) if r.pos / n_pos > PURE * r.neg / n_neg]
    con = [i for i, r in enumerate(top) if r.z < 0][:AGAINST]

    def hits(batches):
        features = Features(names)
        for ys, whole in text_batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array([features.of(t) for t in whole], pa.list_(pa.int32()))], ["y", "hits"])

    found = taught.mapInArrow(hits, "y int, hits array<int>").toArrow()
    # one order, whichever task is done first
    pairs = sorted(zip(found.column("y").to_pylist(), found.column("hits").to_pylist()), key=lambda x: zlib.crc32(repr(x).encode()))
    rows, y = [r for _, r in pairs], np.array([k for k, _ in pairs])
    pro = cover([set(r) for r, k in zip(rows, y) if k], pro, FOR)
    if not pro:
        return None
    voters = np.array([*pro, *con])
    side = np.r_[np.ones(len(pro)), np.zeros(len(con))]
    spot = np.full(len(names), -1)
    spot[voters] = np.arange(len(voters))
    votes = np.zeros((len(rows), len(voters)))
    for i, r in enumerate(rows):
        v = spot[r]
        votes[i, v[v >= 0]] = 1
    posteriors = [fit_label_model(votes, side, n_pos / (n_pos + n_neg), y == 0, abstain).posterior(votes) for abstain in (False, True)]
    weights, bias = fit_best(rows, posteriors, y, len(names), cut)
    return Classifier(names, weights, bias)


def scorer(model: Classifier | None):
    """A function from texts to scores, which remembers words from one block to the next."""
    features = Features(model.names) if model else None

    def of(whole: list[str]) -> np.ndarray:
        if model is None:
            return np.zeros(len(whole))
        s = np.array([model.weights[features.of(t)].sum() + model.bias for t in whole])
        return 1 / (1 + np.exp(-np.clip(s, -40, 40)))

    return of


SCORES = "doc_id long, mark long, score double, predicted int"


def score(docs: DataFrame, model: Classifier | None, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (of the text), score, predicted for every row, in one pass; null and empty texts get the score of a text without features.

    Without a model every score is 0.
    """
    def run(batches):
        score_of = scorer(model)
        for ids, whole, marks in marked_batches(batches):
            s = score_of(whole)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), marks, pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "mark", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_mark(F.col(text_col)).alias("mark")).mapInArrow(run, SCORES)


def scored_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, mark, held_out, score, predicted; the rows held out aren't learnt from. A null id isn't held out."""
    out = remainder(F.col("doc_id"), 3) == 1
    model = learn(docs, labels.where(~out))
    return score(docs, model).select("doc_id", "mark", F.coalesce(out, F.lit(False)).alias("held_out"), "score", "predicted")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: as ``scored_rows``, without the mark."""
    return scored_rows(docs, labels).drop("mark")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns; rows without an id stay.

    Rows are dropped in the pass that scores them: each is decided by its own text, so rows
    that repeat an id are told apart, and no document moves.
    """
    model = learn(docs, labels.where(~(remainder(F.col("doc_id"), 3) == 1)))
    if model is None:
        return docs
    ship(docs.sparkSession)
    names = docs.columns
    id_at, text_at = (next(i for i, c in enumerate(names) if c == name) for name in ("doc_id", "text"))

    def run(batches):
        score_of = scorer(model)
        for batch in batches:
            toxic = [s >= CUT for _, whole in text_batches([batch.select([id_at, text_at])]) for s in score_of(whole)]
            stay = ~np.array(toxic, bool) | pc.is_null(batch.column(id_at)).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(stay))

    return docs.mapInArrow(run, docs.schema)
