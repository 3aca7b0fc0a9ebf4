"""Token counts by rank-synchronous merging of arrays, for a byte-pair model with pieces and scores.

A text is cut at spaces into pre-tokens (no piece has a space inside), distinct ones are counted once
and remembered. A batch of pre-tokens is one ragged array of symbols. In each round every sequence
finds its best-ranked adjacent pair and applies it at all its places, all sequences at once, until none
has a pair left; the surviving symbols are counted, one for a piece and one per UTF-8 byte for a
character that is none.

The model merges the best pair first and of equals the leftmost. Applying a pair at all places is the
same unless a merge makes a neighbouring pair that ranks at least as well; a round stops at the first
such place of a sequence, so that the new pair has its turn.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loreframe.llm.wordarrays import slices

SPACE = "▁"
CACHED_WORDS = 300_000  # pre-tokens remembered per task; a full memory is emptied and filled anew
NEVER = np.int32(2**31 - 1)


class MergeTable:
    """Symbols and ranked merges of a piece model."""

    def __init__(self, pieces: list[tuple[str, float]]):
        scores: dict[str, float] = dict(pieces)
        chars = sorted({c for p in scores for c in p})
        names = chars + [p for p in scores if len(p) > 1]
        number = {p: i for i, p in enumerate(names)}
        rank_of = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        left, right, merged = [], [], []
        for p in scores:
            for k in range(1, len(p)):
                if p[:k] in number and p[k:] in number:
                    left.append(number[p[:k]])
                    right.append(number[p[k:]])
                    merged.append(number[p])
        self.size = len(names)
        keys = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.merged = np.array(merged, np.int32)[order]
        self.rank = np.array([rank_of[scores[names[m]]] for m in self.merged], np.int32)
        self.code_points = np.array([ord(c) for c in chars], np.int64)
        self.is_piece = np.array([c in scores for c in chars], bool)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of symbol pairs; NEVER where they do not merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        known = (left >= 0) & (right >= 0)
        if len(self.keys):
            known &= self.keys[at] == key
        else:
            known[:] = False
        rank = np.full(len(key), NEVER, np.int32)
        rank[known] = self.rank[at[known]]
        return rank, np.where(known, self.merged[at] if len(self.keys) else 0, -1).astype(np.int32)


def count_symbols(table: MergeTable, words: list[str]) -> np.ndarray:
    """Number of tokens of each word."""
    total = np.zeros(len(words), np.int64)
    if not words:
        return total
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.array([len(w) for w in words], np.int64)
    seq = np.repeat(np.arange(len(words)), lengths)
    at = np.minimum(np.searchsorted(table.code_points, points), len(table.code_points) - 1)
    known = table.code_points[at] == points
    sym = np.where(known, at, -1).astype(np.int32)
    # characters that are no piece stay as their bytes if nothing merges them
    bytes_of = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    cost = np.where(known & table.is_piece[at], 1, bytes_of)
    while len(sym):
        rank = np.full(len(sym), NEVER, np.int32)
        merged = np.full(len(sym), -1, np.int32)
        inner = np.flatnonzero(seq[:-1] == seq[1:])
        rank[inner], merged[inner] = table.pairs(sym[inner], sym[inner + 1])
        heads = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
        best = np.minimum.reduceat(rank, heads)
        sizes = np.diff(np.append(heads, len(sym)))
        done = best == NEVER
        if done.any():
            ended = np.repeat(done, sizes)
            total += np.bincount(seq[ended], cost[ended], len(words)).astype(np.int64)
            keep = ~ended
            sym, seq, cost, rank, merged = sym[keep], seq[keep], cost[keep], rank[keep], merged[keep]
            if not len(sym):
                break
            best, sizes = best[~done], sizes[~done]
        bound = np.repeat(best, sizes)
        hit = rank == bound
        # a run of overlapping places: every second one, from the left
        index = np.arange(len(hit))
        run = index - np.maximum.accumulate(np.where(hit, -1, index))
        use = np.flatnonzero(hit & (run % 2 == 1))
        new, s = merged[use], seq[use]
        # the neighbours as they are when this place has its turn
        before = use - 1
        has_left = (before >= 0) & (seq[np.maximum(before, 0)] == s)
        left = sym[np.maximum(before, 0)]
        if len(use) > 1:
            joined = np.concatenate([[False], use[1:] == use[:-1] + 2])
            left[joined] = new[np.flatnonzero(joined) - 1]
        after = use + 2
        has_right = (after < len(sym)) & (seq[np.minimum(after, len(sym) - 1)] == s)
        right = sym[np.minimum(after, len(sym) - 1)]
        better = np.minimum(
            np.where(has_left, table.pairs(left, new)[0], NEVER), np.where(has_right, table.pairs(new, right)[0], NEVER)
        ) <= rank[use]
        # in each sequence up to and with the first place that makes a pair ranking as well
        opens = np.concatenate([[True], s[1:] != s[:-1]])
        start = np.maximum.accumulate(np.where(opens, np.arange(len(use)), 0))
        seen = np.concatenate([[0], np.cumsum(better)])
        use = use[(seen[:-1] - seen[start]) == 0]
        sym[use] = merged[use]
        cost[use] = 1
        keep = np.ones(len(sym), bool)
        keep[use + 1] = False
        sym, seq, cost = sym[keep], seq[keep], cost[keep]
    return total


def _pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text: a word with the spaces before it; spaces at the end are one more."""
    if not text:
        return []
    words = (" " + text.replace(SPACE, " ")).split(" ")[1:]
    if "" not in words:
        return [SPACE + w for w in words]
    out, spaces = [], 0
    for w in words:
        spaces += 1
        if w:
            out.append(SPACE * spaces + w)
            spaces = 0
    if spaces:
        out.append(SPACE * spaces)
    return out


def piece_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Token counts of texts under a piece model with byte fallback that keeps white space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
    ]
    table = MergeTable(pieces)
    known: dict[str, int] = {}

    def count(texts: list[str]) -> list[int]:
        split = [_pre_tokens(t) for t in texts]
        new = set().union(*split) - known.keys()
        if len(known) + len(new) > CACHED_WORDS:
            known.clear()
            new = set().union(*split)
        new = sorted(new, key=len)
        at = 0
        while at < len(new):  # ragged arrays of bounded size, words of like length together
            to, room = at, 1 << 18
            while to < len(new) and (room > 0 or to == at):
                room -= len(new[to])
                to += 1
            part = new[at:to]
            known.update(zip(part, count_symbols(table, part).tolist()))
            at = to
        return [sum([known[w] for w in words]) for words in split]

    return count


def _count(counter: Callable[[], Callable[[list[str]], list[int]]], limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter()
        for whole in batches:
            for batch in slices(whole, "text", 1 << 22):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                tokens = count(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array([n > limit for n in tokens], pa.bool_()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return run


def token_counts(
    docs: DataFrame, counter: Callable[[], Callable[[list[str]], list[int]]], limit: int = 4096
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs(doc_id, text)``.

    ``counter()`` is called once in each task and gives the function from texts to counts. A null or
    empty text has 0 bytes and tokens. Rows are independent of each other: repeated ones, a null doc_id
    and other columns change nothing.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _count(counter, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
