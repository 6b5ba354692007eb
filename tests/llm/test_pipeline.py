import hashlib
from collections import Counter

import pytest
import tiktoken
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F

import corpus_pipeline
from sheafline.llm import bpe, mixing, toxicity
from sheafline.llm.common import Workspace, matched, text_mark
from test_duplicates import brute, normal
from test_mixing import taken_by_hand


def kept_exactly(rows):
    """Of equal texts, the largest id."""
    best = {}
    for i, t in rows:
        best[normal(t)] = max(best.get(normal(t), i), i)
    return sorted((i, t) for i, t in rows if best[normal(t)] == i)


def kept_nearly(rows):
    """Of each class by brute force, the smallest id."""
    least = {i: c for i, c, _ in map(eval, brute(rows))}
    return sorted((i, t) for i, t in rows if least[i] == i)


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Rows (doc_id, text) after each stage, and the last one's."""
    docs, ws, out = spark.read.parquet(f"{sf}/documents.parquet"), Workspace(spark, "t"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = ws.write(stage(spark, docs, sf), str(k))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            out.append((before, docs))
    return out, docs


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_against_brute_force(spark, sf, stages):
    (toxic, exact, near, mixed), encoded = stages
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bad = {r.doc_id for r in toxicity.scored(toxic[0], labels).where("predicted = 1").collect()}
    assert sorted(rows(toxic[1])) == sorted(r for r in rows(toxic[0]) if r[0] not in bad)
    assert sorted(rows(exact[1])) == kept_exactly(rows(exact[0]))
    assert sorted(rows(near[1])) == kept_nearly(rows(near[0]))
    sources = [(r.doc_id, r.source, r.text) for r in mixed[0].select("doc_id", "source", "text").collect()]
    taken = {i: max(1, int(n / size + 0.5)) for i, _, size, n in taken_by_hand(sources) if n}
    assert Counter(i for i, _ in rows(mixed[1])) == taken
    table = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks(path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = Counter((i, len(table.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows(mixed[1]))
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in encoded.collect()) == want


def test_stages_keep_odd_rows(spark, sf, odd, empty):
    """Columns stay whatever their names, and the rows are those that each stage has to keep."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for docs in (odd, empty):
        before = Counter(rows(docs))
        toxic, exact, near, mixed = (stage(spark, docs, sf) for _, stage in corpus_pipeline.STAGES[:-1])
        for df in (toxic, exact, near, mixed):
            assert df.columns == docs.columns
        marked = toxicity.scored_rows(docs, labels)
        bad = {(r.doc_id, r.mark) for r in marked.where("predicted = 1 AND doc_id IS NOT NULL").collect()}
        gone = {(r.doc_id, r.text) for r in docs.select("doc_id", "text", text_mark(F.col("text")).alias("m")).collect() if (r.doc_id, r.m) in bad}
        assert Counter(rows(toxic)) == Counter({k: n for k, n in before.items() if k not in gone})
        best = {}
        for i, t in before:
            if i is not None:
                best[normal(t)] = max(best.get(normal(t), i), i)
        assert Counter(rows(exact)) == Counter({(i, t): n if i is None else 1 for (i, t), n in before.items() if i is None or best[normal(t)] == i})
        taken = mixing.mix(docs, Workspace(spark, "t"))[0].where("taken > 0").collect()
        times = Counter()
        for r in taken:
            times[r.doc_id, r["size"]] = max(times[r.doc_id, r["size"]], max(1, int(r.taken / r["size"] + 0.5)))
        size = {(r.doc_id, r.text): r.n for r in docs.select("doc_id", "text", mixing.words(F.col("text")).alias("n")).collect()}
        assert Counter(rows(mixed)) == +Counter({k: n * times[k[0], size[k]] for k, n in before.items()})
        assert set(rows(near)) <= set(before)


def test_lists_too_long_to_broadcast(spark, docs):
    """Beyond the bound the same rows come out of a join by shuffle."""
    list_of = docs.where("doc_id % 3 = 0").select("doc_id", text_mark(F.col("text")).alias("mark"))
    kept = [sorted(rows(matched(docs, Workspace(spark, "t"), list_of, "left_anti", "x", few=few))) for few in (0, 10**6)]
    assert kept[0] == kept[1] == sorted(r for r in rows(docs) if r[0] % 3)
    plan = matched(docs, Workspace(spark, "t"), list_of, "left_anti", "x")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan.lower()


def test_stages_move_no_documents(spark, sf, docs):
    """Filtering and mixing leave the documents where they are: no shuffle above them."""
    for stage in (corpus_pipeline.toxicity_stage, corpus_pipeline.exact_dedup_stage, corpus_pipeline.near_dedup_stage, corpus_pipeline.mixing_stage):
        plan = stage(spark, docs, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan, stage.__name__
