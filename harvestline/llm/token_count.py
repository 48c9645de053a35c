"""Token counts by rank-synchronous merging of ragged numpy arrays, for a sentencepiece BPE model with byte fallback."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: No piece has a space after another character, so no merge crosses the start of a run of spaces.
_PRETOKEN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NONE = np.int64(1 << 40)
#: Pre-tokens whose counts a Python worker keeps from task to task; beyond that it starts anew.
CACHE = 500_000
_COUNTS: dict[str, dict[str, int]] = {}


@dataclass
class Merges:
    """Symbols are piece ids; a pair's key is left * size + right. Ranks order the merges; equal ones go from the left."""

    size: int
    chars: np.ndarray  # sorted code points that are pieces
    char_ids: np.ndarray
    keys: np.ndarray  # sorted pair keys
    merged: np.ndarray
    ranks: np.ndarray
    at_once: np.ndarray  # by key: merging it never makes a pair of a lower or an equal rank, so all its places can go at once

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair's key, or -1."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), at, -1)


def load(model_file: str) -> Merges:
    """The merges of a sentencepiece BPE model with an identity normalizer."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model_file)
    normal = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    ids = {sp.id_to_piece(i): i for i in normal}
    if any(SPACE in p.lstrip(SPACE) for p in ids):
        raise ValueError("a piece has a space inside")
    scores = {i: sp.get_score(i) for i in normal}
    rank = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
    size = sp.get_piece_size()
    rows = sorted((ids[p[:k]] * size + ids[p[k:]], i, rank[scores[i]]) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
    keys, merged, ranks = (np.array(x, dtype=np.int64) for x in zip(*rows))
    lowest = np.full(size, NONE)  # of the pairs that a piece is a part of
    np.minimum.at(lowest, keys // size, ranks)
    np.minimum.at(lowest, keys % size, ranks)
    chars = sorted((ord(p), i) for p, i in ids.items() if len(p) == 1)
    return Merges(size, np.array([c for c, _ in chars]), np.array([i for _, i in chars]), keys, merged, ranks, lowest[merged] > ranks)


def count_tokens(words: list[str], m: Merges) -> np.ndarray:
    """Tokens of each pre-token. All words merge in step; each applies its own lowest-ranked pair in a step."""
    lens = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    seq = np.repeat(np.arange(len(words)), lens)
    at = np.minimum(np.searchsorted(m.chars, codes), len(m.chars) - 1)
    sym = np.where(m.chars[at] == codes, m.char_ids[at], -1)
    unknown_bytes = np.where(sym < 0, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), 0)
    total = np.bincount(seq, weights=unknown_bytes, minlength=len(words)).astype(np.int64)
    known = np.zeros(len(words), dtype=np.int64)

    def lookup(i: np.ndarray) -> None:
        """Find the pair that begins at each place of i again."""
        j = np.minimum(i + 1, len(sym) - 1)
        pair[i] = np.where((j > i) & (seq[i] == seq[j]), m.find(sym[i], sym[j]), -1)

    pair = np.full(len(sym), -1, dtype=np.int64)
    lookup(np.arange(len(sym)))
    while len(sym):
        rank = np.where(pair >= 0, m.ranks[pair], NONE)
        starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        best = np.minimum.reduceat(rank, starts)
        live = np.repeat(best < NONE, np.diff(np.r_[starts, len(sym)]))
        if not live.all():  # those that are done leave
            known += np.bincount(seq[~live & (sym >= 0)], minlength=len(words))
            sym, seq, pair, rank = sym[live], seq[live], pair[live], rank[live]
            if not len(sym):
                break
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = best[best < NONE]
        hit = rank == np.repeat(best, np.diff(np.r_[starts, len(sym)]))
        where = np.flatnonzero(hit)
        first = np.r_[True, seq[where[1:]] != seq[where[:-1]]]
        where = where[first | m.at_once[pair[where]]]
        run = np.flatnonzero(np.r_[True, np.diff(where) != 1])  # in a run of one symbol every other pair goes
        where = where[(np.arange(len(where)) - np.repeat(run, np.diff(np.r_[run, len(where)]))) % 2 == 0]
        sym[where] = m.merged[pair[where]]
        keep = np.ones(len(sym), dtype=bool)
        keep[where + 1] = False
        place = np.cumsum(keep) - 1
        new = place[where]
        sym, seq, pair = sym[keep], seq[keep], pair[keep]
        again = np.zeros(len(sym), dtype=bool)
        again[new] = again[np.maximum(new - 1, 0)] = True
        lookup(np.flatnonzero(again))
    return total + known


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs, as the sentencepiece library counts them.

    A null or empty text has 0 bytes and 0 tokens. Long texts are counted whole; a task holds the pre-tokens of a few
    documents and a bounded table of counts. Repeated rows are counted alike; columns other than doc_id and text are not read.
    """
    merges = load(model_file)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = _COUNTS.setdefault(model_file, {})
        for frame in frames:
            n_bytes, n_tokens = [], []
            for i in range(0, len(frame), 128):
                texts = [t or "" for t in frame["text"].iloc[i : i + 128]]
                split = [_PRETOKEN.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
                n_bytes += [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                if len(counts) > CACHE:
                    counts.clear()
                new = list({w for s in split for w in s}.difference(counts))
                if new:
                    counts.update(zip(new, count_tokens(new, merges).tolist()))
                n_tokens += [sum(map(counts.__getitem__, s)) for s in split]
            out = pd.DataFrame({"doc_id": frame["doc_id"], "n_bytes": n_bytes, "n_tokens": n_tokens})
            yield out.astype({"doc_id": "Int64", "n_bytes": "int64", "n_tokens": "int64"}).assign(over_limit=[n > limit for n in n_tokens])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(batches, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
