import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheafline.llm import bpe, common, token_counts, token_files
from sheafline.llm.common import Workspace
from sheafline.llm.pretokens import Pieces, pattern_splitter

JSON, RANKS, WORD = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


def local(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_counts_are_the_librarys(request, which):
    df = request.getfixturevalue(which)
    t = Tokenizer.from_file(JSON)
    rows = local(df)
    n = [len(e.ids) for e in t.encode_batch([x for _, x in rows], add_special_tokens=False)]
    got = sorted(map(repr, map(tuple, token_counts.token_counts(df, JSON).collect())))
    assert got == sorted(repr((i, len(x.encode()), k, k > 512)) for (i, x), k in zip(rows, n))


def test_merging_runs_of_one_symbol():
    m = token_counts.RankMerger(JSON)
    t = Tokenizer.from_file(JSON)
    words = ["a" * n for n in (1, 2, 3, 4, 5, 7, 16, 33)] + ["abababab", "the", "zzzzz", " lololol", "=" * 67]
    n, ids = m.merge([w.encode() for w in words])
    want = [t.encode(w).ids for w in words]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_bpe_round_trip(spark, request, which):
    df = request.getfixturevalue(which)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, x in local(df):
        ids = enc.encode_ordinary(x)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(x.encode()).hexdigest()))
    got = bpe.round_trip(df, Workspace(spark, "t"), RANKS, P.PATTERN).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_small_blocks_give_the_same_ids(spark, docs):
    whole = bpe.encode(docs, Workspace(spark, "t"), RANKS, P.PATTERN)
    small = bpe.encode(docs, Workspace(spark, "t"), RANKS, P.PATTERN, block_bytes=20_000)
    assert whole.exceptAll(small).count() == 0 and whole.count() == small.count()


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_token_files(spark, request, which):
    df = request.getfixturevalue(which)
    t = Tokenizer.from_file(WORD)
    rows = sorted(local(df), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = [t.encode(x, add_special_tokens=False).ids + [1] for _, x in rows]
    got = token_files.write_and_read(df, Workspace(spark, "t"), WORD).collect()
    pairs = sorted((repr(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(rows, ids))
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == pairs
    spans = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [i for i, _ in rows]


def test_files_are_read_selectively(spark, docs):
    out = Workspace(spark, "t").path
    token_files.write_tokens(docs, out, WORD, 1, files=1, row_group_bytes=64 << 10, page_bytes=8 << 10)
    paths = [f for f in token_files.read_tokens(spark, out, ()).inputFiles() if "/tokens/" in f]
    meta = pq.ParquetFile(paths[0].removeprefix("file://")).metadata
    column = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert "RLE_DICTIONARY" in column["ids.list.element"].encodings and "DELTA_BINARY_PACKED" in column["doc_id"].encodings
    assert meta.num_row_groups > 1 and column["doc_id"].has_offset_index and column["doc_id"].has_column_index
    plan = token_files.read_tokens(spark, out, ()).where("doc_id = 7")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1] and "EqualTo(doc_id,7)" in plan


def test_empty_tables(spark, empty):
    assert token_counts.token_counts(empty, JSON).count() == 0
    assert bpe.round_trip(empty, Workspace(spark, "t"), RANKS, P.PATTERN).count() == 0
    assert token_files.write_and_read(empty, Workspace(spark, "t"), WORD).count() == 0


def test_rows_that_repeat_an_id_have_one_order(spark):
    rows = [(i % 3, f"text {i} " + "word " * (i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def got(df):
        return sorted(tuple(r) for r in token_files.write_and_read(df, Workspace(spark, "t"), WORD).collect())

    assert got(df.repartition(5)) == got(df.orderBy(F.rand(3)).coalesce(1))


def test_a_block_of_words_is_the_librarys_and_cut_once(monkeypatch):
    """Texts of a block are encoded together: each different word is cut once, however often it is there."""
    seen, cut = [], token_files.PARTS
    monkeypatch.setattr(token_files, "PARTS", lambda text: seen.append(text) or cut(text))
    encode, t = token_files.text_encoder(WORD), Tokenizer.from_file(WORD)
    rng = random.Random(4)
    signs = [*"abzAZ09'’s t\t\n\r\x0b\x0c\x1c\x1d\x1f\x85\xa0\u3000\u200b\x00ßÿÀÖ×÷µªº²İıſКж日ก\u0301😀<|>.,", "<|endoftext|>", "'re", "I'm", "e\u0301"]
    odd = ["".join(rng.choice(signs) for _ in range(rng.randrange(50))) for _ in range(3000)]
    for texts in (["Same words, " * 5000, "", None, "same Words, words"], odd, [], [None]):
        ids, n = encode(pa.array(texts, pa.string()))
        want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    assert sorted(seen[0].split("\n")) == ["same", "same", "words", "words,", "words,"]


def test_blocks_of_a_batch():
    texts = ["x" * n for n in (3, 9, 0, 30, 1, 1, 1, 12)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], ["doc_id", "text"])
    got = [b.column(1).to_pylist() for b in common.sliced([batch, batch.slice(0, 0)], 10)]
    assert sum(got, []) == texts and len(got) > 2 and all(sum(len(x or "") for x in b[:-1]) <= 10 for b in got)


def test_pretokens_of_a_block_are_those_of_its_pieces():
    rng = random.Random(5)
    signs = [*"abAZ09'’s t\t\n\x0b\x0c\x1c\x85\xa0\u3000\x00ßéжд日😀.,", "'re", " ", " ", "  ", " \n"]
    odd = ["".join(rng.choice(signs) for _ in range(rng.randrange(50))) for _ in range(3000)]
    split = pattern_splitter(P.PATTERN)
    for texts in ([*odd, None, "", " ", " a", "a "], [], [None], ["  "], ["a b", "a b"]):
        words, flat, sizes = bpe.pretokens(pa.array(texts, pa.string()), split)
        pieces, ends = Pieces(split), np.cumsum(sizes)
        got = [[words[k] for k in flat[a:b]] for a, b in zip(ends - sizes, ends)]
        assert got == [[pieces.words[k] for k in pieces.sequence(t or "")] for t in texts]


def test_blocks_are_written_from_small_batches(spark, docs):
    """Tasks get batches of a block's size at most, and the session's setting stays."""
    key, seen, write = "spark.sql.execution.arrow.maxBytesPerBatch", [], Workspace.write_bucketed
    before = spark.conf.get(key, None)
    ws = Workspace(spark, "t")
    ws.write_bucketed = lambda *a: seen.append(spark.conf.get(key)) or write(ws, *a)
    bpe.round_trip(docs, ws, RANKS, P.PATTERN, block_bytes=1 << 20)
    assert seen == [str(1 << 20)] and spark.conf.get(key, None) == before
