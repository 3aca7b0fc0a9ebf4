"""Ranked lexical search, reversed: the items' terms are the index and the documents stream through it.

Items come in blocks of bounded size. A block's distinct terms, with the items that hold each, are broadcast.
The first pass over the documents counts these terms in every whole text; its counts are written, and from them
come the corpus figures: documents with terms, all terms, documents a term. The second pass reads the counts,
scores every document for every item it shares a term with, and keeps the best k of each item in a heap, so a
task gives at most k rows an item. Heaps are then merged, in groups of 256 tasks first.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from loreframe.llm.tables import empty_like
from loreframe.llm.wordarrays import slices, text_bytes
from loreframe.session import written

BLOCK_BYTES = 32 << 20  # of the terms, postings and heaps of the items that are broadcast together
CELLS = 1 << 21  # scores held at a time
STRETCH = 1 << 22  # bytes of text split at a time
MERGED = 256  # heaps merged in the first step

RESULT = "item bigint, doc_id bigint, score bigint"


def _fold_table() -> np.ndarray:
    """Bytes to bytes: A-Z to a-z, digits, a-z and all beyond ASCII as they are, others to a blank."""
    table = np.arange(256, dtype=np.uint8)
    kept = np.zeros(256, bool)
    for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        kept[low : high + 1] = True
    table[~kept] = 0x20
    table[0x41:0x5B] += 0x20
    return table


_FOLD = _fold_table()


def split_terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(terms of all texts in order, n+1 offsets of the texts); a null text has none."""
    data, offsets = text_bytes(column)
    folded = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets.tobytes()), pa.py_buffer(_FOLD[data].tobytes()))
    split = pc.ascii_split_whitespace(folded)
    terms = split.flatten()
    filled = pc.binary_length(terms).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate([[0], np.cumsum(filled)])
    bounds = split.offsets.to_numpy()
    return terms.filter(pa.array(filled)), before[bounds - bounds[0]]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", STRETCH):
            terms, bounds = split_terms(batch.column("text"))
            sets = [sorted(set(terms.slice(x, y - x).to_pylist())) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(sets, pa.list_(pa.string()))], names=["item", "terms"])


@dataclass
class Index:
    """A block's inverted index: items of term t are ``items[starts[t] : starts[t + 1]]``."""

    terms: list[str]
    starts: np.ndarray
    items: np.ndarray
    numbers: np.ndarray  # the block's items


def _index(rows: list) -> Index:
    places: dict[str, list[int]] = {}
    for at, row in enumerate(rows):
        for term in row["terms"]:
            places.setdefault(term, []).append(at)
    terms = sorted(places)
    starts = np.concatenate([[0], np.cumsum([len(places[t]) for t in terms])]).astype(np.int64)
    items = np.concatenate([np.array(places[t], np.int64) for t in terms])
    return Index(terms, starts, items, np.array([r["item"] for r in rows], np.int64))


def _count(index: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(index.value.terms, pa.large_string())
        width = len(known)
        for whole in batches:
            for batch in slices(whole, "text", STRETCH):
                terms, bounds = split_terms(batch.column("text"))
                code = pc.index_in(terms, value_set=known)
                hit = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
                row = np.searchsorted(bounds, hit, side="right") - 1
                cell, tf = np.unique(row * width + code.drop_null().to_numpy().astype(np.int64), return_counts=True)
                cuts = pa.array(np.searchsorted(cell, np.arange(batch.num_rows + 1) * width).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(cuts, pa.array((cell % width).astype(np.int32))),
                        pa.ListArray.from_arrays(cuts, pa.array(tf.astype(np.int64))),
                    ],
                    names=["doc_id", "n", "terms", "tf"],
                )

    return run


class Heaps:
    """The best k (score, document) of each item; of equal scores the smaller doc_id, one without an id last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.heaps: list[list[tuple]] = [[] for _ in range(items)]
        self.least = np.zeros(items, np.int64)  # what a document's score must reach
        self.place = np.full(items, -(1 << 63), np.int64)  # and with that score, the greatest id that is turned away

    def update(self, scores: np.ndarray, ids: list[int | None]) -> None:
        """``scores`` has a row for each document and a column for each item."""
        place = np.array([(1 << 63) - 1 if i is None else i for i in ids], np.int64)
        better = (scores > self.least) | ((scores == self.least) & (place[:, None] < self.place) & (scores > 0))
        row, item = np.nonzero(better)
        score = scores[row, item]
        order = np.lexsort((place[row], -score, item))
        row, item, score = row[order], item[order], score[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        for r, i, s in zip(*(x[nth < self.k].tolist() for x in (row, item, score))):
            heap, entry = self.heaps[i], (s, -int(place[r]), ids[r])
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry[:2] > heap[0][:2]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[i], self.place[i] = heap[0][0], -heap[0][1]


def _score(index: Broadcast, weights: Broadcast, docs_with_terms: int, all_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, items, weight = index.value.starts, index.value.items, weights.value
        width, degree = len(index.value.numbers), np.diff(index.value.starts)
        exact = np.bincount(items, minlength=width).max() * int(weight.max(initial=0)) * 1_000_000 < 1 << 53
        heaps = Heaps(width, k)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            n = batch.column("n").to_numpy()
            bounds = batch.column("terms").offsets.to_numpy()
            term = batch.column("terms").flatten().to_numpy()
            tf = batch.column("tf").flatten().to_numpy()
            bounds = bounds - bounds[0]
            row = np.repeat(np.arange(len(ids)), np.diff(bounds))
            m = 100 - 90 + (90 * n * docs_with_terms) // all_terms
            part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
            made = np.concatenate([[0], np.cumsum(degree[term])])[bounds]  # contributions before each document
            at = 0
            while at < len(ids):
                to = int(np.searchsorted(made, made[at] + CELLS, side="right")) - 1
                to = max(at + 1, min(to, at + max(1, CELLS // width), len(ids)))
                mine = slice(bounds[at], bounds[to])
                per = degree[term[mine]]
                shift = np.repeat(starts[term[mine]] - (np.cumsum(per) - per), per)
                cell = np.repeat(row[mine] - at, per) * width + items[shift + np.arange(int(per.sum()))]
                value = np.repeat(part[mine], per)
                if exact:  # sums of whole numbers below 2**53
                    total = np.bincount(cell, value, minlength=(to - at) * width).astype(np.int64)
                else:
                    total = np.zeros((to - at) * width, np.int64)
                    np.add.at(total, cell, value)
                heaps.update(total.reshape(to - at, width), ids[at:to])
                at = to
        best = [(int(index.value.numbers[i]), e[2], e[0]) for i, heap in enumerate(heaps.heaps) for e in heap]
        if best:
            columns = [pa.array(x, pa.int64()) for x in zip(*best)]
            part = pa.array([TaskContext.get().partitionId()] * len(best), pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, part], names=["item", "doc_id", "score", "part"])

    return run


def _merged(best: DataFrame, k: int) -> DataFrame:
    """The k best of each item and their rank, from the heaps of all tasks."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = W.partitionBy("item", F.floor(F.col("part") / MERGED)).orderBy(*order)
    fewer = best.withColumn("i", F.row_number().over(some)).where(F.col("i") <= k)
    ranked = fewer.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def _blocks(items: DataFrame, k: int) -> tuple[DataFrame, list[int]]:
    """Items with terms and a block number each, and the blocks; one item alone may pass the bound."""
    cost = 64 * (k + 1) + F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 96)
    sized = items.where(F.size("terms") > 0).withColumn("cost", cost)
    total = sized.agg(F.sum("cost")).first()[0]
    if total is None:
        return sized, []
    count = -(-total // BLOCK_BYTES)
    while True:
        dealt = sized.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(count)))
        groups = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost")).collect()
        if all(g["n"] == 1 or g["cost"] <= 2 * BLOCK_BYTES for g in groups):
            return dealt, sorted(g["block"] for g in groups)
        count *= 2


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` documents with the highest score above 0 for every item.

    ``docs(doc_id, text)``, ``items(item_id, text)``. Terms are the maximal runs of digits, letters and characters
    beyond ASCII, only A-Z lower-cased. A term's weight falls with the number of documents that hold it, its
    share in a document grows with its count and falls with the document's length (``_score``, all in whole
    numbers but for the weight's logarithm). Equal scores go by ascending doc_id (a whole number; null last).

    A null or empty text has no terms; an item without terms, or without a document that shares one, gives no
    row. Rows are documents and items of their own, also when ids repeat. Other columns are ignored. Every block
    of items costs a pass over the texts.
    """
    spark = docs.sparkSession
    numbered = written(items.select("item_id", "text", F.monotonically_increasing_id().alias("item")), "items")
    with_terms = numbered.select("item", "text").mapInArrow(_item_terms, "item long, terms array<string>")
    dealt, blocks = _blocks(written(with_terms, "item-terms"), k)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = empty_like(spark, "item long, rank int, doc_id long, score long")
    for block in blocks:
        rows = dealt.where(F.col("block") == block).select("item", "terms").orderBy("item").collect()
        index = spark.sparkContext.broadcast(_index(rows))
        counts = texts.mapInArrow(_count(index), "doc_id long, n long, terms array<int>, tf array<long>")
        counts = written(counts, "term-counts")
        docs_with_terms, all_terms = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not all_terms:
            break
        holding = counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        df = np.zeros(len(index.value.terms), np.int64)
        df[[r["term"] for r in holding]] = [r["count"] for r in holding]
        weight = [math.floor(1000 * math.log((2 * docs_with_terms + 2) / (2 * int(d) + 1))) for d in df]
        weights = spark.sparkContext.broadcast(np.array(weight, np.int64))
        best = counts.where(F.size("terms") > 0).mapInArrow(
            _score(index, weights, docs_with_terms, all_terms, k), f"{RESULT}, part long"
        )
        found = found.union(_merged(best, k))
    return found.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
