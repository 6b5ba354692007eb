"""Token counts by rank-synchronous array merging.

Pre-tokens of a block are held as one ragged numpy array. In each round every
sequence finds its lowest-ranked adjacent pair and all occurrences of it merge at
once, in all sequences together; what survives is counted.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_batches
from .pretokens import UNSURE, Pieces

BIG = np.iinfo(np.int32).max
#: Pieces remembered by a worker before it starts anew.
REMEMBERED = 400_000
#: Bytes of pre-tokens merged together.
MERGED_BYTES = 2_000_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies -> the byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


class RankMerger:
    """Merges of a byte-level vocabulary, as sorted arrays of pair keys."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.first = np.zeros(256, np.int64)
        for symbol, byte in byte_symbols().items():
            self.first[byte] = vocab[symbol]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], BIG), np.where(hit, self.made[at], 0)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols left in each word, their ids in word order); no word is empty."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.first[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def ranked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            nxt = np.minimum(at + 1, len(ids) - 1)
            r, m = self.rank(ids[at], ids[nxt])
            r[(seq[nxt] != seq[at]) | (nxt == at)] = BIG
            return r, m

        rank, made = ranked(np.arange(len(ids)))
        while len(ids):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(ids)])
            finished = np.repeat(least == BIG, lengths)
            if finished.any():
                done.append((seq[finished], ids[finished]))
                keep = ~finished
                ids, seq, rank, made = ids[keep], seq[keep], rank[keep], made[keep]
                live = least != BIG
                least, lengths = least[live], lengths[live]
                if not len(ids):
                    break
            merged = rank == np.repeat(least, lengths)
            # where occurrences overlap (a run of one symbol), every other one merges, from the left
            at = np.flatnonzero(merged)
            head = np.r_[True, np.diff(at) != 1]
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[run % 2 == 0]
            ids[at] = made[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            ids, seq, rank, made = ids[keep], seq[keep], rank[keep], made[keep]
            again = np.unique(np.r_[at, at[at > 0] - 1])
            rank[again], made[again] = ranked(again)
        if not done:
            return size, ids
        where, what = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(where, kind="stable")
        return np.bincount(where, minlength=len(words)), what[order]

    def counts(self, words: list[bytes]) -> np.ndarray:
        out, start, held = [], 0, 0
        for i, w in enumerate(words):
            held += len(w)
            if held >= MERGED_BYTES:
                out.append(self.merge(words[start : i + 1])[0])
                start, held = i + 1, 0
        if start < len(words):
            out.append(self.merge(words[start:])[0])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def counter(path: str):
    """A function: texts -> token counts, as the tokenizers library gives them."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    merger = RankMerger(path)

    import public_tokenizers
    import regex

    find = regex.compile(public_tokenizers.PATTERN).findall
    cut = regex.compile("|".join(f"({regex.escape(s)})" for s in specials)).split if specials else None
    is_special = set(specials)

    def plain(piece: str) -> list[str]:
        if UNSURE.search(piece):
            spans = tokenizer.pre_tokenizer.pre_tokenize_str(piece)
            return [piece[a:b] for _, (a, b) in spans]
        return find(piece)

    def split(piece: str) -> list[str]:
        if cut is None or not any(s in piece for s in specials):
            return plain(piece)
        parts = [p for p in cut(piece) if p]
        return [w for p in parts for w in ([p] if p in is_special else plain(p))]

    state: dict = {"pieces": Pieces(split), "n": np.zeros(0, np.int64)}

    def count(texts: list[str]) -> np.ndarray:
        if len(state["pieces"]) > REMEMBERED:
            state.update(pieces=Pieces(split), n=np.zeros(0, np.int64))
        pieces = state["pieces"]
        found = [np.array(pieces.sequence(t), np.int64) for t in texts]
        new = pieces.words[len(state["n"]) :]
        n = merger.counts([w.encode() for w in new])
        for i, w in enumerate(new):
            if w in is_special:
                n[i] = 1
        state["n"] = np.concatenate([state["n"], n])
        return np.array([state["n"][s].sum() for s in found], np.int64)

    return count


_COUNTERS: dict = {}


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, in one pass without a shuffle.

    Null and empty texts have no bytes and no tokens. Rows that repeat an id each get a row.
    """
    def run(batches):
        count = _COUNTERS.get(path) or _COUNTERS.setdefault(path, counter(path))
        for ids, texts in text_batches(batches):
            n = count(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.selectExpr(f"CAST({id_col} AS BIGINT) AS doc_id", f"{text_col} AS text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
