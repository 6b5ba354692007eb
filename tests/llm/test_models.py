import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.llm import language_id, language_model, toxicity
from sheafline.llm.common import Workspace


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = np.array(label, bool)
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


SF01 = "/root/testdata/sf0.1"


def test_toxicity_on_rows_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    got = toxicity.scored(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert auc(got.score.values, got.toxic.values) > 0.95
    assert got[got.toxic == 0].predicted.mean() < 0.005 and got[got.toxic == 1].predicted.mean() > 0.75


def test_toxicity_of_odd_tables(spark, odd, empty, labels):
    got = toxicity.scored(odd, labels).collect()
    assert len(got) == odd.count() and {r.held_out for r in got if r.doc_id is None} == {False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert toxicity.scored(empty, labels).count() == 0
    nothing = labels.where("toxic > 5")
    assert {(r.score, r.predicted) for r in toxicity.scored(odd, nothing).collect()} == {(0.0, 0)}
    twice = labels.select("doc_id", "toxic").union(labels.select(F.lit(None).cast("long"), F.lit(1))).union(labels.select("doc_id", F.lit(None).cast("int")))
    assert toxicity.scored(odd, twice).count() == odd.count()
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.2
    hit = np.array([0.7, 0.5, 0.4, 0.3, 0.6])
    votes = (rng.random((4000, 5)) < np.where(y[:, None], hit, 0.03)).astype(float)
    votes = np.c_[votes, votes[:, 0]]  # a copy of a voter
    model = toxicity.fit_label_model(votes, np.ones(6), 0.2)
    assert model.groups[0] == model.groups[5] and len(set(model.groups)) == 5
    assert np.allclose(model.fires[1], hit, atol=0.08)
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.93


def test_language_on_rows_held_out(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = language_id.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert got.score.between(0, 1).all() and (got.lang_pred == got.lang).mean() > 0.97


def test_language_of_odd_tables(spark, odd, empty):
    got = {r.doc_id: r for r in language_id.identified(odd).collect() if r.doc_id is not None}
    for r in odd.collect():
        if r.doc_id is not None:
            none = not any(c.isalpha() for c in r.text or "")
            assert (got[r.doc_id].lang_pred == "und") == none
            assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert language_id.identified(empty).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identified(unlabelled).collect()} == {"und"}


def test_words_switch_languages():
    rows = [("a", " ".join(f"ka{i % 7}ko" for i in range(k, k + 60))) for k in range(20)] + [("b", " ".join(f"zu{i % 7}zi" for i in range(k, k + 60))) for k in range(20)]
    field = language_id.train(rows)
    words = ["ka1ko"] * 6 + ["zu2zi"] * 6
    emit = np.stack([field.weights[language_id.features(w, field.lexicon)].sum(axis=0) for w in words])
    got = language_id.forward_backward(emit, field.move, np.array([12])).argmax(axis=1)
    assert got.tolist() == [0] * 6 + [1] * 6 and np.trace(field.move) > field.move.sum() - np.trace(field.move)


def test_language_is_learnt_from_whole_texts(spark):
    """All texts open with one long passage; what tells them apart comes after it."""
    opening = " ".join(f"li{k % 50}cense" for k in range(700))
    rows = [(i, f"{opening} " + " ".join(f"{'zu' if i % 2 else 'ka'}{k % 9}ro" for k in range(1400)), "ab"[i % 2]) for i in range(40)]
    field = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    own = spark.createDataFrame([(1, "ka1ro ka2ro ka3ro"), (2, "zu1ro zu2ro zu3ro")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(own, field).collect()} == {1: "a", 2: "b"}
    assert "ka1ro" in field.lexicon and "zu1ro" in field.lexicon


def test_no_language_is_lost_to_a_repeated_id(spark):
    """All rows of a language have one id, and one of them is repeated very often."""
    rows = [(i, f"alpha{i} beta gamma", "en") for i in range(1500)] + [(7, f"eins{k % 40} zwei drei", "de") for k in range(1500)] + [(8, "un deux trois", "fr")] * 1500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = language_id.learn(df)
    assert field.languages == ["de", "en", "fr"]
    again = language_id.learn(df.repartition(7))
    assert (again.weights == field.weights).all() and (again.move == field.move).all() and again.lexicon == field.lexicon


def slow_language(field, text):
    """(language, its mean marginal) of a text, one word after another in logs."""
    words = [w for w in (text or "").lower().split() if language_id.LETTER.search(w)]
    if not words:
        return "und", 0.0
    emit = [field.weights[language_id.features(w, field.lexicon)].astype(float).sum(axis=0) for w in words]
    move = field.move.astype(float)
    ahead = [emit[0]]
    for e in emit[1:]:
        ahead.append(e + np.logaddexp.reduce(ahead[-1][:, None] + move, axis=0))
    back = [np.zeros(len(field.languages))]
    for e in emit[:0:-1]:
        back.append(np.logaddexp.reduce(move + (e + back[-1])[None, :], axis=1))
    joint = np.array(ahead) + np.array(back[::-1])
    mean = np.exp(joint - np.logaddexp.reduce(joint, axis=1)[:, None]).mean(axis=0)
    return field.languages[int(mean.argmax())], float(mean.max())


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_languages_equal_the_slow_way(spark, request, which):
    df = request.getfixturevalue(which)
    field = language_id.learn(df.where("doc_id % 4 <> 1"))
    text = {r.doc_id: r.text for r in df.where("doc_id IS NOT NULL").select("doc_id", "text").collect()}
    got = [r for r in language_id.identify(df, field).collect() if r.doc_id is not None]
    assert {r.doc_id for r in got} == set(text)
    for r in got:
        lang, score = slow_language(field, text[r.doc_id])
        assert r.score == pytest.approx(score, abs=1e-3)
        # float32 and float64 may differ where two languages come out equal
        assert r.lang_pred == lang or abs(r.score - score) < 1e-6


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    sizes, labels = np.array([4, 2, 1]), 3
    emit, move = rng.standard_normal((7, labels)), rng.standard_normal((labels, labels))
    got = language_id.forward_backward(emit, move, sizes)
    at = 0
    for n in sizes:
        mass = np.zeros((n, labels))
        for path in np.ndindex(*[labels] * n):
            w = math.exp(sum(emit[at + t, s] for t, s in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
            for t, s in enumerate(path):
                mass[t, s] += w
        assert np.allclose(got[at : at + n], mass / mass.sum(axis=1, keepdims=True), atol=1e-5)
        at += n


def base_scores(rows):
    counts, ends = Counter(), 0
    token = [((x or "").encode().lower().split(), i is not None and zlib.crc32(str(i).encode()) % 10 == 0) for i, x in rows]
    for ws, out in token:
        if not out:
            counts.update(ws)
            ends += 1
    counts[None] = ends
    n, v = sum(counts.values()), sum(c > 0 for c in counts.values())
    for (i, _), (ws, out) in zip(rows, token):
        ws = [*ws, None]
        yield i, out, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_base_scores(spark, request, which):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = sorted(map(tuple, language_model.score_texts(df, Workspace(spark, "t"), block_bytes=100_000).collect()), key=repr)
    want = sorted(base_scores(rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want]) and all(g[6] < 0 for g in got)


def slow_scores(rows, least):
    """Scores by dictionaries of whole contexts: no blocks, buckets, keys or arrays."""
    lm = language_model
    docs = [((x or "").encode().lower().split(), i is not None and zlib.crc32(str(i).encode()) % 10 == 0) for i, x in rows]
    count = Counter(w for ws, out in docs if not out for w in ws)
    learnt = sum(not out for _, out in docs)
    common = {w: k for k, w in enumerate(sorted(count, key=lambda w: (-count[w], w))[: lm.COMMON], 1)}

    def symbol(w):
        return common.get(w) or lm.class_of(w)

    size, once = Counter({lm.END: learnt}), Counter()
    for w, c in count.items():
        size[symbol(w)] += c
        once[symbol(w)] += c == 1 and w not in common
    novel = {s: once[s] / (size[s] + once[s]) if size[s] else float(s > lm.COMMON) for s in range(lm.SYMBOLS)}
    root = {s: (size[s] + 0.5) / (sum(size.values()) + 0.5 * lm.SYMBOLS) for s in range(lm.SYMBOLS)}
    root_unknown = sum(root[s] * novel[s] for s in root)
    runs = [([lm.END] * lm.ORDER + [symbol(w) for w in ws] + [lm.END], out) for ws, out in docs]
    following = {}
    for seq, out in runs:
        for k in range(lm.ORDER, len(seq)):
            for d in range(1, lm.ORDER + 1):
                if not out:
                    following.setdefault(tuple(seq[k - d : k]), Counter())[seq[k]] += 1
    kept = {}

    def known(context, s):
        p = root[s]
        for d in range(1, len(context) + 1):
            c = kept.get(context[-d:])
            if c:
                p = (c[s] + len(c) * p) / (sum(c.values()) + len(c))
        return p

    def unknown(context):
        u = root_unknown
        for d in range(1, len(context) + 1):
            c = kept.get(context[-d:])
            if c:
                u = (sum(n * novel[s] for s, n in c.items()) + len(c) * u) / (sum(c.values()) + len(c))
        return u

    # shorter ones first, as they decide what longer ones diverge from
    for context in sorted(following, key=len):
        c = following[context]
        n = sum(c.values())
        if n >= least and sum(k * math.log(k / n / known(context[1:], s)) for s, k in c.items()) > 2 * len(c):
            kept[context] = c
    assert len(rows) < 50 or {len(c) for c in kept} >= {1, 2}
    for (ws, _), (seq, _) in zip(docs, runs):
        total = 0.0
        for k, w in enumerate([*ws, None], lm.ORDER):
            context, s = tuple(seq[k - lm.ORDER : k]), seq[k]
            c = learnt if w is None else count[w]
            total += math.log10(known(context, s) * (c / (size[s] + once[s]) if s > lm.COMMON else 1) if c else unknown(context))
        yield total


@pytest.mark.parametrize("which,least", [("docs", 10), ("docs", 3), ("odd", 3)])
def test_scores_equal_the_slow_way(spark, request, which, least):
    df = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = sorted(((i, out, n), s) for (i, out, n, *_), s in zip(base_scores(rows), slow_scores(rows, least)) if i is not None)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens), r.score) for r in language_model.score_texts(df, Workspace(spark, "t"), least=least, block_bytes=100_000).collect() if r.doc_id is not None)
    assert [g[0] for g in got] == [w[0] for w in want]
    # probabilities travel as 32-bit floats: half a unit in the last place of each token's
    off = np.abs(np.array([g[1] for g in got]) - [w[1] for w in want])
    tokens = np.array([g[0][2] for g in got])
    assert (off <= 3e-8 * tokens + 1e-9).all(), (off / tokens).max()


def test_tree_beats_the_base_on_rows_held_out(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = language_model.score_texts(docs, Workspace(spark, "t")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_rare_contexts_count_in_large_tables(spark):
    """A passage seen 40 times is learnt however many other tokens there are."""
    rng = np.random.default_rng(9)
    out = next(i for i in range(1000, 2000) if language_model.held_out(i))
    rows = [(i, " ".join(f"f{k}" for k in rng.integers(0, 1000, 10_000)) + (" qa qb qc qd" if i % 2 else "")) for i in range(88)]
    rows.append((out, "qa qb qc qd"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in language_model.score_texts(df, Workspace(spark, "t")).collect()}[out]
    assert got.held_out and got.score > got.base_score + 8


def grown_tree(seq, at, novel):
    """A tree over all contexts of a sequence, with every context of each depth as candidate."""
    n = language_model.SYMBOLS
    tree = language_model.SuffixTree(np.bincount(seq[at], minlength=n).astype(float), novel)
    for depth in range(1, language_model.ORDER + 1):
        key = language_model.context_keys(seq, at, depth)
        keys = np.unique(key)
        entry, times = np.unique(np.searchsorted(keys, key) * n + seq[at], return_counts=True)
        tree.add(keys, entry // n, entry % n, times)
    return tree


def chain(size=4000):
    rng = np.random.default_rng(6)
    out = [1, 2]
    for _ in range(size):
        out.append((out[-1] + 2 * out[-2]) % 5 + 1 if rng.random() < 0.8 else int(rng.integers(1, 8)))
    return np.array(out)


def test_tree_keeps_contexts_that_diverge_and_sums_to_one():
    novel = np.zeros(language_model.SYMBOLS)
    novel[7] = 0.3
    seq, at = language_model.sequence(chain(), np.array([4002]))
    tree = grown_tree(seq, at, novel)
    assert len(tree.levels[1]["keys"]) > len(tree.levels[2]["keys"]) > -1 and len(tree.levels[1]["keys"]) >= 20
    noise = np.random.default_rng(1).integers(1, 8, 4000)
    flat = grown_tree(*language_model.sequence(noise, np.array([4000])), novel)
    assert len(flat.levels[1]["keys"]) < 5
    for k in (5, 50, 500):
        before = seq[: at[k]]
        every = np.arange(language_model.SYMBOLS)
        runs = np.concatenate([np.r_[before, s] for s in every])
        last = (np.arange(len(every)) + 1) * (len(before) + 1) - 1
        share = 1 - novel  # of known tokens
        known = 10 ** tree.score(runs, last, np.zeros(len(every), bool), share)
        unknown = 10 ** tree.score(runs[: last[0] + 1], last[:1], np.ones(1, bool), share[:1])
        assert known.sum() + unknown[0] == pytest.approx(1)


def test_tree_scores_by_the_longest_kept_suffix():
    novel = np.zeros(language_model.SYMBOLS)
    seq, at = language_model.sequence(chain(), np.array([4002]))
    tree = grown_tree(seq, at, novel)
    counts = {}
    for d in range(1, 4):
        key = language_model.context_keys(seq, at, d)
        for k, s in zip(key.tolist(), seq[at].tolist()):
            counts.setdefault((d, k), Counter())[s] += 1
    for i in range(10, 200):
        s, p = int(seq[at[i]]), tree.root[seq[at[i]]]
        for d in range(1, 4):
            k = int(language_model.context_keys(seq, at[i : i + 1], d)[0])
            if k in tree.levels[d - 1]["keys"]:
                c = counts[d, k]
                p = (c[s] + len(c) * p) / (sum(c.values()) + len(c))
        got = tree.score(seq, at[i : i + 1], np.zeros(1, bool), np.ones(1))
        assert got[0] == pytest.approx(math.log10(p))


def test_empty_table(spark, empty):
    assert language_model.score_texts(empty, Workspace(spark, "t")).count() == 0
