"""Keyword top-k of many queries at once: postings of the asked patterns, upper bounds to stop early.

Queries come in blocks of bounded size, blocks in groups with a bounded number of pattern letters; a group's distinct
patterns are broadcast. One pass over the texts finds the patterns of every row and field and writes the postings, a
row's patterns with the fields that hold them; no text is moved. From the postings come each pattern's frequency and the
most that it can add to a score. Each block then reads the postings, newest rows first, and keeps the best k of every
query in a heap. As a query's k-th score rises, its most frequent patterns, as long as they cannot reach that score
together, no longer make a row a candidate: only rows with one of the others are. Of these only rows are scored whose
rare patterns, added up from the postings, and number of frequent ones, counted in bits, can lift them above that score.
The newest rows are read in a round of their own, then more and more:
later rows are older, so they must score more than the k-th score of all rounds before. So the result is exact. Heaps are
merged in groups of 256 tasks first. Scores are whole hundredths until the end.
"""

from __future__ import annotations

import copy
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loreframe.functions.constants import PHRASE_WEIGHTS, TERM_WEIGHTS
from loreframe.operators.scorers import PatternSet
from loreframe.session import written

BLOCK_BYTES = 64 << 20  # of patterns and heaps of the queries that are answered together
CELLS = 1 << 21  # weights or scores held at a time
WARM_UP = 64  # rows at most scored before the first bounds are taken
MERGED = 256
GROUP_LETTERS = 2 << 20  # of distinct patterns that one pass over the texts looks for
GROUP_BLOCKS = 16
GROWTH = 8  # a round reads about so many times the rows of those before
FIRST_ROUND = 1024  # rows at least
PAIRS = 1 << 17  # (row, query) pairs bounded at a time
DENSE = 512  # patterns with the most (row, query) hits, held as bits of a row; a multiple of 64

FIELDS = list(PHRASE_WEIGHTS)  # bit i of a mask is field i
_MASKS = np.arange(1 << len(FIELDS))


def _by_mask(weights: dict[str, float]) -> np.ndarray:
    """Hundredths that a pattern adds, by the fields that hold it."""
    return sum(((_MASKS >> i) & 1) * round(100 * weights[f]) for i, f in enumerate(FIELDS)).astype(np.int64)


PHRASE, TERM = _by_mask(PHRASE_WEIGHTS), _by_mask(TERM_WEIGHTS)
TITLE = 1 << FIELDS.index("source_title")


@dataclass
class Asked:
    """A block's queries: unit i adds the weight of pattern ``pattern[i]`` to the score of query ``query[i]``."""

    ids: np.ndarray
    patterns: list[str]
    query: np.ndarray
    pattern: np.ndarray
    phrase: np.ndarray  # whether the unit is the query's phrase
    place: np.ndarray | None = None  # of each pattern among those of the block's group


def _asked(rows: list) -> Asked:
    known: dict[str, int] = {}
    units = []
    for q, row in enumerate(rows):
        for text, is_phrase in [(row["phrase"], True), *((t, False) for t in row["terms"])]:
            units.append((q, known.setdefault(text.lower(), len(known)), is_phrase))
    query, pattern, phrase = (np.array(x) for x in zip(*units))
    return Asked(np.array([r["query_id"] for r in rows], np.int64), list(known), query, pattern, phrase)


def _hits(patterns: PatternSet, texts: list[str]) -> list[list[int]]:
    """The patterns of each field; a field that ends the one before, as a row's content mostly does, is read once."""
    if len(texts) > 1 and texts[-1] and texts[-2].endswith(texts[-1]):
        return [*_hits(patterns, texts[:-2]), *patterns.found_with_suffix(texts[-2], texts[-1])]
    return [patterns.found(text) if text else [] for text in texts]


def _masked(fields: list[list[int]]) -> tuple[list[int], list[int]]:
    """The patterns of a row and the fields that hold each, as a mask."""
    groups = {0: set().union(*fields)}
    for bit, hits in enumerate(fields):
        if hits:
            held = {mask | 1 << bit: own.intersection(hits) for mask, own in groups.items()}
            groups = {mask: own.difference(hits) for mask, own in groups.items()} | held
    patterns = [p for own in groups.values() for p in own]
    return patterns, [mask for mask, own in groups.items() for _ in own]


def _find(patterns: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = PatternSet(patterns.value)
        for batch in batches:
            texts = [batch.column(f).to_pylist() for f in FIELDS]
            found, masks, kept = [], [], []
            for i, fields in enumerate(zip(*texts)):
                own, mask = _masked(_hits(known, [text.lower() if text else "" for text in fields]))
                if own:
                    kept.append(i)
                    found.append(own)
                    masks.append(mask)
            rows = batch.take(pa.array(kept, pa.int64()))
            arrays = [rows.column("id"), rows.column("tie"), pa.array(found, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "tie", "patterns", "masks"])

    return run


def _count(width: int):
    """How many rows of a task hold a pattern with a mask: (pattern, mask) as a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width * len(_MASKS), np.int64)
        for batch in batches:
            pattern, mask = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("patterns", "masks"))
            counts += np.bincount(pattern * len(_MASKS) + mask, minlength=len(counts))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["unit", "n"])

    return run


class Heaps:
    """The best k (score, row) of each query. Rows come newest first, so a later one of the same score is no better."""

    def __init__(self, queries: int, k: int, least: np.ndarray | None = None):
        self.k = k
        self.heaps: list[list[tuple]] = [[] for _ in range(queries)]
        self.least = np.zeros(queries, np.int64) if least is None else least.copy()  # a row must score more
        self.count = 0

    def update(self, row: np.ndarray, query: np.ndarray, score: np.ndarray, ids: list[str], ties: list[int]) -> None:
        """Scores of (row, query) pairs, in the order of the rows."""
        better = score > self.least[query]
        order = np.lexsort((row[better], -score[better], query[better]))
        row, query, score = row[better][order], query[better][order], score[better][order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        for r, q, s in zip(*(x[nth < self.k].tolist() for x in (row, query, score))):
            heap = self.heaps[q]
            self.count += 1
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -self.count, ids[r], ties[r]))
            elif s > heap[0][0]:
                heapq.heapreplace(heap, (s, -self.count, ids[r], ties[r]))
            if len(heap) == self.k:
                self.least[q] = heap[0][0]  # at least what it was, as only better rows are held


class Scorer:
    """Scores postings for a block of queries, leaving out pairs that cannot reach a query's k-th score.

    Rows with a pattern in their title can score much more than others, so the others have bounds of their own.
    ``term_most`` and ``phrase_most`` hold both, (without, with a title hit) x patterns, or one for all rows. A row
    without a title hit has none of the block's patterns in its title.
    """

    def __init__(self, asked: Asked, frequency: np.ndarray, term_most: np.ndarray, phrase_most: np.ndarray, k: int):
        # a query's units from the most frequent pattern on, with the most that they can add so far
        order = np.lexsort((-frequency[asked.pattern], asked.query))
        self.query, self.pattern, self.phrase = asked.query[order], asked.pattern[order], asked.phrase[order]
        self.first = np.searchsorted(self.query, np.arange(len(asked.ids) + 1))
        phrase_most, term_most = (np.atleast_2d(m)[:, self.pattern] for m in (phrase_most, term_most))
        most = np.broadcast_to(np.where(self.phrase, phrase_most, term_most), (2, len(order)))
        sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(most, axis=1)], axis=1)
        self.reach = sums[:, 1:] - sums[:, self.first[self.query]]
        self.by_pattern = np.argsort(self.pattern, kind="stable")
        self.width = len(asked.patterns)
        # the frequent patterns of each query as bits, with the most that one of them adds, and the units of the others
        self.bit = np.full(self.width, -1)
        hits = frequency * np.bincount(self.pattern, minlength=self.width)
        frequent = np.argsort(-hits, kind="stable")[:DENSE]
        self.bit[frequent] = np.arange(len(frequent))
        dense = self.bit[self.pattern] >= 0
        own, of = np.unique(self.query[dense] * DENSE + self.bit[self.pattern[dense]], return_inverse=True)
        self.bits = self._packed(len(asked.ids), own // DENSE, own % DENSE)
        self.one_most = np.zeros((2, len(asked.ids)), np.int64)
        for kind in (0, 1):
            np.maximum.at(self.one_most[kind], own // DENSE, np.bincount(of, most[kind, dense], len(own)).astype(np.int64))
        self.others = self.by_pattern[~dense[self.by_pattern]]
        self.others_from = np.searchsorted(self.pattern[self.others], np.arange(self.width + 1))
        self.ids, self.place, self.k = asked.ids, asked.place, k
        self.heaps = Heaps(len(asked.ids), k)
        self.scored = 0

    def fresh(self, least: np.ndarray) -> Scorer:
        """A scorer of the same queries without rows, where a row must score more than ``least``."""
        other = copy.copy(self)
        other.heaps, other.scored = Heaps(len(self.ids), self.k, least), 0
        return other

    def chunk(self, row: np.ndarray, pattern: np.ndarray, mask: np.ndarray, ids: list[str], ties: list[int]) -> None:
        """Postings (row, pattern, mask) of some rows, all of them newer than those that follow."""
        titled = np.zeros(len(ids), bool)
        titled[row[(mask & TITLE) > 0]] = True
        queries = len(self.heaps.heaps)
        seen = np.zeros(len(ids) * queries, bool)
        for kind in (0, 1):
            mine = titled[row] == kind
            if not mine.any():
                continue
            # units that make a row a candidate
            deciding = self.by_pattern[self.reach[kind, self.by_pattern] > self.heaps.least[self.query[self.by_pattern]]]
            starts = np.searchsorted(self.pattern[deciding], np.arange(self.width + 1))
            held = pattern[mine]
            per = np.diff(starts)[held]
            at = np.repeat(starts[held] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
            seen[np.repeat(row[mine], per) * queries + self.query[deciding[at]]] = True
        pairs = np.flatnonzero(seen)
        if not len(pairs):
            return
        self.scored += len(pairs)
        pairs = self._possible(pairs, row, pattern, mask, titled)
        masks = np.zeros(len(ids) * self.width, np.int8)
        masks[row * self.width + pattern] = mask
        step = max(1, CELLS // max(1, int(np.diff(self.first).max())))
        for x in range(0, len(pairs), step):
            r, q = np.divmod(pairs[x : x + step], queries)
            n = self.first[q + 1] - self.first[q]
            ends = np.cumsum(n)
            unit = np.repeat(self.first[q] - (ends - n), n) + np.arange(int(n.sum()))
            held = masks[np.repeat(r, n) * self.width + self.pattern[unit]]
            value = np.where(self.phrase[unit], PHRASE[held], TERM[held])
            self.heaps.update(r, q, np.add.reduceat(value, ends - n), ids, ties)

    @staticmethod
    def _packed(rows: int, row: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Bits of rows, (words of 64 bits) x rows."""
        flags = np.zeros((rows, DENSE), bool)
        flags[row, bit] = True
        return np.ascontiguousarray(np.packbits(flags, axis=1).view(np.uint64).T)

    def _possible(self, pairs: np.ndarray, row: np.ndarray, pattern: np.ndarray, mask: np.ndarray, titled: np.ndarray) -> np.ndarray:
        """Of (row, query) pairs, as numbers, those whose score may pass the query's k-th one."""
        queries = len(self.heaps.heaps)
        dense = self.bit[pattern] >= 0
        bits = self._packed(len(titled), row[dense], self.bit[pattern[dense]])
        rare = np.zeros(len(titled) * queries, np.int32)
        held = pattern[~dense]
        per = self.others_from[held + 1] - self.others_from[held]
        at = np.repeat(self.others_from[held] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
        unit, found = self.others[at], np.repeat(mask[~dense], per)
        value = np.where(self.phrase[unit], PHRASE[found], TERM[found]).astype(np.int32)
        np.add.at(rare, np.repeat(row[~dense], per) * queries + self.query[unit], value)
        kept = []
        for x in range(0, len(pairs), PAIRS):
            some = pairs[x : x + PAIRS]
            r, q = np.divmod(some, queries)
            common = np.zeros(len(some), np.int16)
            for mine, asked in zip(bits, self.bits):  # word by word, which is faster than a sum along short rows
                common += np.bitwise_count(np.take(mine, r) & np.take(asked, q))
            kept.append(some[rare[some] + common * self.one_most[titled[r].astype(np.int64), q] > self.heaps.least[q]])
        return np.concatenate(kept)


def _score(block: Broadcast, least: Broadcast, width: int):
    """The best rows of each query of a block, a :class:`Scorer`, in a task's postings of a group of ``width`` patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = block.value.fresh(least.value)
        own = np.full(width, -1)
        own[scorer.place] = np.arange(scorer.width)
        room = max(1, min(WARM_UP, CELLS // len(scorer.query)))  # all units of a row may decide at first
        most = max(1, 4 * CELLS // max(scorer.width, len(scorer.ids)))
        for batch in batches:
            ids, ties = batch.column("id").to_pylist(), batch.column("tie").to_pylist()
            lengths = np.diff(batch.column("patterns").offsets.to_numpy())
            pattern, mask = (batch.column(c).flatten().to_numpy() for c in ("patterns", "masks"))
            row, pattern = np.repeat(np.arange(len(ids)), lengths), own[pattern]
            row, pattern, mask = (v[pattern >= 0] for v in (row, pattern, mask))
            bounds = np.searchsorted(row, np.arange(len(ids) + 1))
            at = 0
            while at < len(ids):
                to = min(len(ids), at + min(room, most))
                mine = slice(bounds[at], bounds[to])
                scorer.chunk(row[mine] - at, pattern[mine], mask[mine], ids[at:to], ties[at:to])
                at, room = to, room * 2
        best = [(int(scorer.ids[q]), e[2], e[3], e[0]) for q, heap in enumerate(scorer.heaps.heaps) for e in heap]
        if best:
            query, row, tie, score = zip(*best)
            part = [TaskContext.get().partitionId()] * len(best)
            arrays = [pa.array(query, pa.int64()), pa.array(row, pa.string())] + [pa.array(c, pa.int64()) for c in (tie, score, part)]
            yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "id", "tie", "hundredths", "part"])

    return run


def _blocks(queries: DataFrame, k: int) -> tuple[DataFrame, list[int]]:
    """Queries with a block number each, and the blocks; one query alone may pass the bound."""
    cost = 64 * (k + 2) + F.octet_length("phrase") + F.aggregate(
        "terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 128
    )
    sized = queries.withColumn("cost", cost)
    total = sized.agg(F.sum("cost")).first()[0]
    count = -(-total // BLOCK_BYTES) if total else 0
    while count:
        dealt = sized.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(count)))
        groups = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost")).collect()
        if all(g["n"] == 1 or g["cost"] <= 2 * BLOCK_BYTES for g in groups):
            return dealt, sorted(g["block"] for g in groups)
        count *= 2
    return sized, []


def _rounds(postings: DataFrame) -> list[Column]:
    """Which rows each round reads by their tie, the newest first; equal ties share a round, those without one are oldest."""
    n = postings.agg(F.count("tie")).first()[0]
    shares = []
    while n >= FIRST_ROUND * GROWTH ** (len(shares) + 1):
        shares.insert(0, GROWTH ** -(len(shares) + 1))
    if not shares:
        return [F.lit(True)]
    cuts = postings.agg(F.percentile_approx("tie", F.array(*[F.lit(1 - x) for x in shares]), F.lit(10000))).first()[0]
    tie = F.col("tie")
    between = [(tie > older) & (tie <= newer) for newer, older in zip(cuts, cuts[1:])]
    return [tie > cuts[0], *between, (tie <= cuts[-1]) | tie.isNull()]


def _groups(dealt: DataFrame, blocks: list[int]) -> Iterator[tuple[list[str], list[Asked]]]:
    """Blocks of queries that one pass over the texts serves, with their distinct patterns."""
    known: dict[str, int] = {}
    group: list[Asked] = []
    for block in blocks:
        asked = _asked(dealt.where(F.col("block") == block).select("query_id", "phrase", "terms").orderBy("query_id").collect())
        letters = sum(map(len, known)) + sum(len(p) for p in asked.patterns if p not in known)
        if group and (letters > GROUP_LETTERS or len(group) == GROUP_BLOCKS):
            yield list(known), group
            known, group = {}, []
        asked.place = np.array([known.setdefault(p, len(known)) for p in asked.patterns], np.int64)
        group.append(asked)
    if group:
        yield list(known), group


def _figures(postings: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many rows hold each pattern, and the most that it adds as a term and as a phrase, outside titles and anywhere."""
    counted = postings.select("patterns", "masks").mapInArrow(_count(width), "unit long, n long")
    totals = counted.groupBy("unit").agg(F.sum("n").alias("n")).toArrow()  # at most 7 rows a pattern
    pattern, mask = np.divmod(totals.column("unit").to_numpy(), len(_MASKS))
    frequency = np.zeros(width, np.int64)
    np.add.at(frequency, pattern, totals.column("n").to_numpy())
    term_most, phrase_most = (np.zeros((2, width), np.int64) for _ in range(2))
    for kind, some in ((0, (mask & TITLE) == 0), (1, np.full(len(mask), True))):
        np.maximum.at(term_most, (kind, pattern[some]), TERM[mask[some]])
        np.maximum.at(phrase_most, (kind, pattern[some]), PHRASE[mask[some]])
    return frequency, term_most, phrase_most


def _kth(best: DataFrame, ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th score of each query so far, 0 where there are fewer rows."""
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("hundredths")))
    found = best.select("query_id", "hundredths", nth.alias("i")).where(F.col("i") == k).toArrow()
    score = dict(zip(found.column("query_id").to_pylist(), found.column("hundredths").to_pylist()))
    return np.array([score.get(q, 0) for q in ids.tolist()], np.int64)


def pattern_topk(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) of the k rows with the highest score above 0 for every query.

    ``queries(query_id, phrase, terms)``, each a contains-style LIKE pattern, letter case aside; ``rows(id, tie,
    source_title, search_text, content)``. A phrase or term adds its weight for every field that holds it, a
    repeated term each time. Of equal scores the greater tie and then the smaller id comes first. A row's texts are
    read once for each group of blocks of queries.
    """
    spark = queries.sparkSession
    known = written(queries.select("query_id", "phrase", "terms"), "asked")
    dealt, blocks = _blocks(known, k)
    order = [F.desc("hundredths"), F.desc("tie"), F.asc("id")]
    result = None
    for patterns, group in _groups(dealt, blocks):
        held = spark.sparkContext.broadcast(patterns)
        found = rows.select("id", "tie", *FIELDS).mapInArrow(_find(held), "id string, tie long, patterns array<int>, masks array<int>")
        postings = written(found, "postings")
        figures = _figures(postings, len(patterns))
        rounds = _rounds(postings)
        for asked in group:
            block = spark.sparkContext.broadcast(Scorer(asked, *(f[..., asked.place] for f in figures), k))
            so_far = None
            for n, own in enumerate(rounds):
                least = spark.sparkContext.broadcast(_kth(so_far, asked.ids, k) if so_far else np.zeros(len(asked.ids), np.int64))
                newest = postings.where(own).sortWithinPartitions(F.desc("tie"), F.asc("id"))
                best = newest.mapInArrow(
                    _score(block, least, len(patterns)), "query_id long, id string, tie long, hundredths long, part long"
                )
                some = W.partitionBy("query_id", F.floor(F.col("part") / MERGED)).orderBy(*order)
                best = best.withColumn("i", F.row_number().over(some)).where(F.col("i") <= k)
                if n < len(rounds) - 1:  # read for the next round's bounds and for the result
                    best = written(best, "best")
                so_far = best if so_far is None else so_far.union(best)
            result = so_far if result is None else result.union(so_far)
    if result is None:
        return spark.createDataFrame([], "query_id long, id string, score double, rank long")
    ranked = result.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= k).select("query_id", "id", (F.col("hundredths") / 100).alias("score"), "rank")
