import hashlib
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sheafline import catalog
from sheafline.operators import answers, keywords
from sheafline.streaming import dialogue
from sheafline.streaming.selection import select_many


# --- keywords


def brute(text, words):
    return [w for w in words if w in (text or "").lower()]


WORDS = ["he", "she", "his", "hers", "", "straße", "日本", "ab", "abc", "bc", "c", "HE", "x" * 50]
TEXTS = ["ushers", "SHE and his", None, "", "日本語 STRASSE straße", "abcabc", "x" * 120, "Hé hë"]


@pytest.mark.parametrize("bound", [1 << 20, 8])
def test_keyword_matches(spark, bound, tmp_path):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    words = spark.createDataFrame([(w, i) for i, w in enumerate(WORDS)] + [("he", 90), (None, 1)], "keyword string, pos int")
    rows = [(i, t, "z") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "z")]
    got = keywords.keyword_matches(spark.createDataFrame(rows, "id int, t string, _low string"), words, F.col("t"), bound)
    assert got.columns == ["id", "t", "_low", "hits"]
    assert sorted((r.id, r.hits) for r in got.collect()) == sorted((i, brute(t, WORDS)) for i, t, _ in rows)
    none = keywords.keyword_matches(spark.createDataFrame(rows, "id int, t string, _low string"), words.limit(0), F.col("t"), bound)
    assert {tuple(r.hits) for r in none.collect()} == {()}


def test_thousands_of_keywords(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(2, 9))) for _ in range(5000)]
    words = list(dict.fromkeys(words))
    texts = ["".join(rng.choice("abcde") for _ in range(2000)) for _ in range(20)]
    table = spark.createDataFrame(list(zip(words, range(len(words)))), "keyword string, pos int")
    got = keywords.keyword_matches(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), table, F.col("t"))
    assert {r.id: r.hits for r in got.collect()} == {i: brute(t, words) for i, t in enumerate(texts)}


# --- answers asked once


def asking(log, fails=""):
    """Notes each prompt it is asked; breaks at the prompt ``fails`` as long as the file of that name is there."""
    def ask(prompt):
        if prompt == fails and os.path.exists(f"{log}.break"):
            raise OSError("lost")
        with open(log, "a") as f:
            f.write(prompt + "\n")
        return None if prompt == "none" else f"answer to {prompt}"

    return ask


def lines(log):
    return Counter(open(log).read().splitlines()) if os.path.exists(log) else Counter()


def test_answers_are_asked_once(spark, tmp_path):
    log, at = str(tmp_path / "log"), f"file://{tmp_path}/table"
    rows = [(f"r{i}", f"p{i % 5}") for i in range(20)] + [("n", None), ("m", "none")]
    prompts = spark.createDataFrame(rows, "request_id string, prompt string").repartition(6)
    for _ in range(3):
        got = {r.request_id: r.answer for r in answers.answer_once(prompts, asking(log), at).collect()}
        assert got == {k: None if p in (None, "none") else f"answer to {p}" for k, p in rows}
    counts = lines(log)
    assert counts.pop("none") == 3 and counts == {f"p{i}": 1 for i in range(5)}
    more = spark.createDataFrame([("a", "p1"), ("b", "p9")], "request_id string, prompt string")
    assert {r.answer for r in answers.answer_once(more, asking(log), at).collect()} == {"answer to p1", "answer to p9"}
    assert lines(log)["p1"] == 1 and lines(log)["p9"] == 1
    # without a completion, what is known is still given, and nothing is asked
    assert {r.request_id: r.answer for r in answers.answer_once(more.limit(2), None, at).collect()} == {"a": "answer to p1", "b": "answer to p9"}


def test_a_killed_task_asks_nothing_twice(spark, tmp_path):
    log, at = str(tmp_path / "log"), f"file://{tmp_path}/table"
    prompts = spark.createDataFrame([(f"r{i:02}", f"p{i:02}") for i in range(30)], "request_id string, prompt string").coalesce(1)
    (tmp_path / "log.break").touch()
    last = max((f"p{i:02}" for i in range(30)), key=lambda p: hashlib.sha256(p.encode()).hexdigest())
    with pytest.raises(Exception, match="lost"):
        answers.answer_once(prompts, asking(log, last), at).collect()
    before = lines(log)
    assert before and last not in before
    (tmp_path / "log.break").unlink()
    got = answers.answer_once(prompts, asking(log, last), at).collect()
    assert len(got) == 30 and all(r.answer == f"answer to p{r.request_id[1:]}" for r in got)
    assert lines(log) == {f"p{i:02}": 1 for i in range(30)}
    assert not os.path.exists(tmp_path / "table/spool")


# --- the dialogue as a stream

SAID = ["3", "java", "done", "26", "", "clear", "scal", "zz", "1", "+2", "1_0", " 4 ", "DONE", "o", "-1"]


def conversations(n, seed):
    rng = random.Random(seed)
    return [(c, t, rng.choice(SAID)) for c in range(n) for t in range(rng.randrange(1, 14))]


def folded(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, word string")
    typed = df.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "word"))), lambda x: x.word).alias("typed"))
    offered = F.array(*map(F.lit, catalog.PRIMARY))
    s = typed.select("conv_id", select_many(offered, F.array(F.lit("rust")), F.col("typed")).alias("s")).select("conv_id", "s.*")
    return sorted((r.conv_id, r.selected, r.remaining, r.done) for r in s.collect())


def test_answered_is_the_fold(spark):
    rows = conversations(60, 2)
    state = {}
    for c, _, w in rows:
        state[c] = dialogue.answered(*state.get(c, (["rust"], [o for o in catalog.PRIMARY if o != "rust"], False)), w, catalog.PRIMARY)
    assert sorted((c, *s) for c, s in state.items()) == folded(spark, rows)


def test_dialogue_over_batches_and_restarts(spark, tmp_path):
    """Answers come in three portions, one of them twice; each start goes on from the checkpoint."""
    rows = conversations(20, 5)
    came, at = str(tmp_path / "came"), str(tmp_path / "at")
    for lo, hi in ((0, 3), (3, 7), (3, 7), (7, 99)):
        part = [r for r in rows if lo <= r[1] < hi]
        spark.createDataFrame(part, "conv_id long, turn long, word string").coalesce(2).write.mode("append").parquet(came)
        dialogue.run_available(spark, came, at, catalog.PRIMARY, ["rust"])
    got = dialogue.latest(spark, at)
    assert sorted((r.conv_id, r.selected, r.remaining, r.done) for r in got.collect()) == folded(spark, rows)


def test_idle_dialogues_expire(spark, tmp_path):
    import time

    came, at = str(tmp_path / "came"), str(tmp_path / "at")
    schema = "conv_id long, turn long, word string"
    spark.createDataFrame([(1, 0, "java")], schema).write.mode("append").parquet(came)
    dialogue.run_available(spark, came, at, catalog.PRIMARY, [], idle_ms=500)
    time.sleep(1)
    spark.createDataFrame([(2, 0, "java")], schema).write.mode("append").parquet(came)
    dialogue.run_available(spark, came, at, catalog.PRIMARY, [], idle_ms=500)
    states = spark.read.parquet(f"{at}/states").orderBy("batch", "conv_id").collect()
    assert any(r.conv_id == 1 and r.expired for r in states) and any(r.conv_id == 2 and not r.expired for r in states)
