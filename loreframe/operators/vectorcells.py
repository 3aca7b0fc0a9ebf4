"""Vector top-k over centroid cells: exact with pruning by the triangle inequality, or on coded residuals.

Every row belongs to the cell of its nearest centroid and is known by its angle to it. A cell is cut into rings of
that angle, the units of pruning. A query at angle t from a centroid is at least ``max(0, t - hi, lo - t)`` away from
all rows of the ring ``[lo, hi]``, so the ring's best possible cosine is known before it is read. The exact search
reads the most promising rings of a query first; its k-th score there, or the smallest score wanted, is the bound
that a ring must reach to be read at all. Nothing that can be among the best k is left out.

Centroids are fitted on a bounded sample, which decides cost alone: every row is in a ring, whatever the centroids.
Rows without direction (null or zero vectors) match nothing. All vectors have one length.

How much is pruned depends on the vectors: rows in groups leave most rings unread, evenly spread directions of many
dimensions leave none, as all rows are then about equally far from everything (``ring_visits`` tells).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window as W, functions as F

from loreframe.operators.blocktopk import QUERIES_PER_BLOCK
from loreframe.session import written

UNIT_BYTES = 8 << 20  # of the rows that one task scores against a block of queries
SAMPLE_BYTES = 32 << 20  # of the rows that centroids and code words are fitted on
MAX_CENTROIDS = 1024
MAX_RINGS = 1 << 16  # rings are broadcast: at most 2 MB
BINS = 256  # of a cell's angles
SLACK = 1e-8  # scores are rounded to 9 digits before they are compared
PAIRS = 1 << 16  # scored exactly at once

HIT = "query_id long, id string, tie long, score double"


@dataclass
class Rings:
    """Centroids, and for each ring its cell, its smallest and greatest angle, and its rows."""

    centroids: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def best_cosines(self, unit: np.ndarray) -> np.ndarray:
        """(queries x rings) the greatest cosine that a row of the ring can have."""
        to_centroid = np.arccos(np.clip(unit @ self.centroids.T, -1.0, 1.0))[:, self.cell]
        apart = np.maximum(0.0, np.maximum(to_centroid - self.high, self.low - to_centroid))
        return np.cos(np.maximum(0.0, apart - 1e-7)) + SLACK  # arccos loses about 1e-8 near 1

    def first(self, best: np.ndarray, k: int) -> np.ndarray:
        """(queries x rings) whether a ring is among the most promising that hold k rows together."""
        order = np.argsort(-best, axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        chosen = np.zeros(best.shape, bool)
        np.put_along_axis(chosen, order, before < k, axis=1)
        return chosen


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have a direction, their unit vectors)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = column.to_pandas() if column.null_count or column.flatten().null_count else None
    if lists is not None:  # nulls are rare
        good = np.array([v is not None and not pd.isna(np.asarray(v, float)).any() for v in lists], bool)
        vectors = np.array([np.asarray(v, float) for v, g in zip(lists, good) if g])
        vectors = vectors.reshape(int(good.sum()), -1)
    else:
        good = np.ones(len(column), bool)
        vectors = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    norm = np.linalg.norm(vectors, axis=1) if len(vectors) else np.zeros(0)
    good[np.flatnonzero(good)[~(norm > 0)]] = False
    return good, vectors[norm > 0] / norm[norm > 0, None]


def fit_centroids(sample: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on unit vectors; a centroid without members stays where it was."""
    rng = np.random.default_rng(42)
    centroids = sample[rng.choice(len(sample), count, replace=False)].copy()
    for _ in range(rounds if count > 1 else 1):
        nearest = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norm = np.linalg.norm(sums, axis=1)
        centroids[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return centroids


def _assign(centroids: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, unit = unit_rows(batch.column("embedding"))
            near = unit @ centroids.value.T
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1.0, 1.0))
            kept = batch.filter(pa.array(good))
            arrays = [kept.column(c) for c in ("id", "tie", "embedding")]
            arrays += [pa.array(cell.astype(np.int32)), pa.array(angle)]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "tie", "embedding", "cell", "angle"])

    return run


@dataclass
class RingIndex:
    """Rows by ring and part, on shared storage, with the rings' bounds."""

    rows: DataFrame  # id, tie, embedding, cell, ring, part
    rings: Rings
    parts: DataFrame  # ring, parts: a ring of many rows is dealt over parts
    sample: np.ndarray


def _sample(rows: DataFrame, total: int, width: int) -> np.ndarray:
    wanted = max(1, SAMPLE_BYTES // (8 * max(1, width)))
    step = max(1, total // wanted)
    taken = rows.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0).select("embedding").limit(2 * wanted)
    vectors = taken.toArrow().column("embedding")
    return unit_rows(vectors)[1]


def build_rings(rows: DataFrame, unit_bytes: int = UNIT_BYTES) -> RingIndex | None:
    """Rings over ``rows(id, tie, embedding)``; None where no row has a direction."""
    spark = rows.sparkSession
    rows = written(rows.select("id", "tie", "embedding").where("embedding is not null"), "vectors")
    total, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if not total or not width:
        return None
    per_unit = max(1, unit_bytes // (8 * width))  # rows
    sample = _sample(rows, total, width)
    if not len(sample):
        sample = unit_rows(rows.select("embedding").limit(1024).toArrow().column("embedding"))[1]
    if not len(sample):
        sample = np.eye(1, width)
    wanted = min(MAX_CENTROIDS, -(-total // per_unit), max(1, SAMPLE_BYTES // (16 * width)), len(sample))
    centroids = fit_centroids(sample, wanted)
    held = spark.sparkContext.broadcast(centroids)
    assigned = written(
        rows.mapInArrow(_assign(held), "id string, tie long, embedding array<float>, cell int, angle double"), "assigned"
    )
    turn = F.least(F.floor(F.col("angle") * (BINS / np.pi)), F.lit(BINS - 1)).cast("int")
    bins = assigned.groupBy("cell", turn.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")
    )
    per_ring = max(per_unit, -(-total * 2 // MAX_RINGS))
    earlier = W.partitionBy("cell").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    dealt = bins.withColumn("turn", F.floor(F.coalesce(F.sum("n").over(earlier), F.lit(0)) / per_ring))
    # at most MAX_CENTROIDS x BINS rows
    table = dealt.toPandas().sort_values(["cell", "turn", "bin"], ignore_index=True)
    if table.empty:
        return None
    table["ring"] = table.groupby(["cell", "turn"]).ngroup()
    rings = table.groupby("ring").agg(cell=("cell", "first"), low=("low", "min"), high=("high", "max"), n=("n", "sum"))
    columns = [rings[c].to_numpy() for c in ("cell", "low", "high", "n")]
    places = spark.createDataFrame(table[["cell", "bin", "ring"]].astype(int), "cell int, bin int, ring int")
    parts = rings.reset_index()[["ring", "n"]].assign(parts=lambda r: -(-r["n"] // per_unit))[["ring", "parts"]]
    parts = spark.createDataFrame(parts.astype(int), "ring int, parts int")
    placed = assigned.withColumn("bin", turn).join(F.broadcast(places), ["cell", "bin"]).join(F.broadcast(parts), "ring")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    placed = placed.select("id", "tie", "embedding", "cell", "ring", part.alias("part"))
    return RingIndex(placed, Rings(centroids, *columns), parts, sample)


def _visits(rings: Broadcast, k: int, least: float, second: bool):
    """Rings that a query reads: the first ones, or then those that can hold a score of its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, unit = unit_rows(batch.column("query_embedding"))
            kept = batch.filter(pa.array(good))
            step = max(1, (1 << 22) // len(rings.value.cell))
            for at in range(0, len(unit), step):
                best = rings.value.best_cosines(unit[at : at + step])
                first = rings.value.first(best, k)
                some = kept.slice(at, step)
                bound = some.column("bound").to_numpy()
                chosen = (~first if second else first) & (best >= bound[:, None])
                row, ring = np.nonzero(chosen)
                taken = some.take(pa.array(row))
                arrays = [taken.column(c) for c in ("query_id", "query_embedding", "bound")]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(ring.astype(np.int32))], names=["query_id", "query_embedding", "bound", "ring"]
                )

    return run


_VISIT = "query_id long, query_embedding array<float>, bound double, ring int"


def _grid(visits: DataFrame, rows: DataFrame, parts: DataFrame, per_block: int) -> tuple[DataFrame, DataFrame]:
    """Visits and rows by (ring, part, block); a ring that many queries visit takes them in blocks."""
    blocks = visits.groupBy("ring").agg(F.ceil(F.count(F.lit(1)) / per_block).cast("int").alias("blocks"))
    sized = blocks.join(parts, "ring")
    block = F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block")
    asked = visits.join(sized, "ring").select(
        "query_id", "query_embedding", "bound", "ring", block, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    offered = rows.join(blocks, "ring").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return asked, offered


def _best_of(held: list[np.ndarray], place: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best (query, row, score) of each query; of equal scores the row of the smaller place first."""
    query, row, score = held
    order = np.lexsort((place[row], -score, query))
    query = query[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else query
    turn = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    order = order[turn < k]
    return [h[order] for h in held]


def _score_cell(k: int, decode=None):
    """Best k rows of a cell for each of its queries, none below the query's bound.

    Scores in single precision, with room for their error, choose the pairs that are scored in double precision: those
    that reach the query's bound and, once it holds k rows, beat the least of them. Rows come in the order of ties.
    """

    def run(asked: pa.Table, offered: pa.Table) -> pa.Table:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if asked.num_rows and offered.num_rows:
            queries = unit_rows(asked.column("query_embedding"))[1]
            vectors = decode(offered) if decode else unit_rows(offered.column("embedding"))[1]
            names = pd.DataFrame({"id": offered.column("id").to_pandas(), "tie": offered.column("tie").to_pandas()})
            turn = names.sort_values(["tie", "id"], ascending=[False, True]).index.to_numpy()
            vectors, place = vectors[turn], np.arange(len(turn))
            least = asked.column("bound").to_numpy() - SLACK
            rough, rough_queries = vectors.astype(np.float32), queries.astype(np.float32).T.copy()
            room = 1.2e-7 * (vectors.shape[1] + 4) * max(1.0, float(np.linalg.norm(vectors, axis=1).max())) + 1e-9
            beaten = np.full(len(queries), -np.inf)  # a score must be above it
            for at in range(0, len(vectors), 512):
                wanted = np.maximum(least, beaten) - room
                near = rough[at : at + 512] @ rough_queries >= wanted.astype(np.float32)
                dense = vectors[at : at + 512] @ queries.T if np.count_nonzero(near) > PAIRS else None
                if dense is not None:
                    near = (dense >= least) & (np.round(dense, 9) > beaten)
                rows, columns = np.nonzero(near)
                for x in range(0, len(rows), PAIRS):
                    row, query = rows[x : x + PAIRS], columns[x : x + PAIRS]
                    score = np.einsum("ij,ij->i", vectors[row + at], queries[query]) if dense is None else dense[row, query]
                    kept = score >= least[query]
                    score = np.round(score, 9)
                    kept &= score > beaten[query]
                    held = _best_of([np.concatenate(pair) for pair in zip(held, (query[kept], row[kept] + at, score[kept]))], place, k)
                    full = np.bincount(held[0], minlength=len(queries)) >= k
                    lowest = np.full(len(queries), np.inf)
                    np.minimum.at(lowest, held[0], held[2])
                    beaten[full] = lowest[full]
            held[1] = turn[held[1]]
        query, row, score = held
        arrays = [pa.array(asked.column("query_id").to_numpy()[query], pa.int64()), offered.column("id").take(pa.array(row))]
        arrays += [offered.column("tie").take(pa.array(row)), pa.array(score, pa.float64())]
        return pa.Table.from_arrays(arrays, names=["query_id", "id", "tie", "score"])

    return run


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("tie"), F.asc("id"))
    return hits.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def _read(visits: DataFrame, index: RingIndex, rows: DataFrame, k: int, per_block: int, decode=None) -> DataFrame:
    asked, offered = _grid(visits, rows, index.parts, per_block)
    keys = ["ring", "part", "block"]
    return asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(_score_cell(k, decode), HIT)


def _bounded(queries: DataFrame, least: float) -> DataFrame:
    asked = queries.select("query_id", F.col("query_embedding").cast("array<float>").alias("query_embedding"))
    return asked.where("query_embedding is not null").withColumn("bound", F.lit(float(least)))


def _search(queries: DataFrame, index: RingIndex, k: int, least: float, per_block: int) -> tuple[DataFrame, DataFrame]:
    """(hits, visits) of the exact search."""
    spark = queries.sparkSession
    rings = spark.sparkContext.broadcast(index.rings)
    asked = written(_bounded(queries, least), "asked")
    first = written(asked.mapInArrow(_visits(rings, k, least, False), _VISIT), "visits")
    hits = written(_ranked(_read(first, index, index.rows, k, per_block), k).drop("rank"), "hits")
    if len(index.rings.cell) == 1:
        return hits, first
    full = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    bound = F.greatest(F.col("bound"), F.coalesce("kth", F.lit(float(least))))
    again = asked.join(full, "query_id", "left").select("query_id", "query_embedding", bound.alias("bound"))
    second = written(again.mapInArrow(_visits(rings, k, least, True), _VISIT), "visits")
    return hits.union(_read(second, index, index.rows, k, per_block)), first.union(second)


def _tables(queries: DataFrame, rows: DataFrame, unit_bytes: int):
    return build_rings(rows, unit_bytes), queries.sparkSession


def exact_topk(
    queries: DataFrame, rows: DataFrame, k: int, least: float, per_block: int = QUERIES_PER_BLOCK, unit_bytes: int = UNIT_BYTES
) -> DataFrame:
    """(query_id, id, score, rank) of the k best cosines, ``least`` at least, for every query.

    ``queries(query_id, query_embedding)``, ``rows(id, tie, embedding)``; of equal scores, rounded to 9 digits, the
    greater tie and then the smaller id comes first. Empty inputs give no rows.
    """
    index, spark = _tables(queries, rows, unit_bytes)
    if index is None:
        return spark.createDataFrame([], "query_id long, id string, score double, rank long")
    hits, _ = _search(queries, index, k, least, per_block)
    return _ranked(hits, k).select("query_id", "id", "score", "rank")


def ring_visits(queries: DataFrame, rows: DataFrame, k: int, least: float, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """(query_id, rings, rings_read, rows, rows_read): how much the exact search reads for each query."""
    index, spark = _tables(queries, rows, unit_bytes)
    if index is None:
        return spark.createDataFrame([], "query_id long, rings long, rings_read long, rows long, rows_read long")
    _, visits = _search(queries, index, k, least, QUERIES_PER_BLOCK)
    sizes = spark.createDataFrame([(i, int(n)) for i, n in enumerate(index.rings.rows)], "ring int, n long")
    read = visits.join(F.broadcast(sizes), "ring").groupBy("query_id")
    return read.agg(F.count(F.lit(1)).alias("rings_read"), F.sum("n").alias("rows_read")).select(
        "query_id",
        F.lit(len(index.rings.cell)).cast("long").alias("rings"),
        "rings_read",
        F.lit(int(index.rings.rows.sum())).alias("rows"),
        "rows_read",
    )


# --- coded residuals ---------------------------------------------------------------------------


@dataclass
class Codes:
    """Product quantiser of residuals: ``words[s]`` are the code words of subspace s."""

    centroids: np.ndarray
    words: np.ndarray  # subspaces x words x dimensions of a subspace

    def padded(self, residual: np.ndarray) -> np.ndarray:
        parts, _, width = self.words.shape
        out = np.zeros((len(residual), parts * width))
        out[:, : residual.shape[1]] = residual
        return out.reshape(len(residual), parts, width)

    def encode(self, unit: np.ndarray, cell: np.ndarray) -> np.ndarray:
        parts = self.padded(unit - self.centroids[cell])
        half = 0.5 * (self.words**2).sum(axis=2)
        return np.stack([(parts[:, s] @ self.words[s].T - half[s]).argmax(axis=1) for s in range(len(self.words))], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray, cell: np.ndarray) -> np.ndarray:
        parts = np.stack([self.words[s][codes[:, s]] for s in range(len(self.words))], axis=1)
        return self.centroids[cell] + parts.reshape(len(codes), -1)[:, : self.centroids.shape[1]]


def fit_codes(sample: np.ndarray, centroids: np.ndarray, width: int, words: int, rounds: int = 8) -> Codes:
    """Code words of ``width`` dimensions each, by k-means on the sample's residuals."""
    rng = np.random.default_rng(7)
    subspaces = -(-sample.shape[1] // width)
    codes = Codes(centroids, np.zeros((subspaces, 1, width)))
    parts = codes.padded(sample - centroids[(sample @ centroids.T).argmax(axis=1)])
    words = min(words, len(sample))
    found = parts[rng.choice(len(parts), words, replace=False)].transpose(1, 0, 2).copy()
    for s in range(subspaces):
        for _ in range(rounds):
            nearest = (parts[:, s] @ found[s].T - 0.5 * (found[s] ** 2).sum(axis=1)).argmax(axis=1)
            counts = np.bincount(nearest, minlength=words)
            sums = np.zeros_like(found[s])
            np.add.at(sums, nearest, parts[:, s])
            found[s][counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return Codes(centroids, found)


def coded_candidates(
    queries: DataFrame,
    rows: DataFrame,
    k: int,
    least: float,
    slack: float = 0.06,
    per_result: int = 8,
    width: int = 4,
    words: int = 256,
    per_block: int = QUERIES_PER_BLOCK,
    unit_bytes: int = UNIT_BYTES,
) -> DataFrame:
    """(query_id, id, tie) whose score on coded residuals is at least ``least - slack``, the best ``per_result * k``
    of a query. A row moves as one byte for every ``width`` dimensions."""
    index, spark = _tables(queries, rows, unit_bytes)
    if index is None:
        return spark.createDataFrame([], "query_id long, id string, tie long")
    codes = spark.sparkContext.broadcast(fit_codes(index.sample, index.rings.centroids, width, words))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            made = codes.value.encode(unit_rows(batch.column("embedding"))[1], cell)
            kept = [batch.column(c) for c in ("id", "tie", "cell", "ring", "part")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([m.tobytes() for m in made], pa.binary())], names=["id", "tie", "cell", "ring", "part", "code"])

    def decode(offered: pa.Table) -> np.ndarray:
        raw = np.frombuffer(b"".join(offered.column("code").to_pylist()), np.uint8)
        return codes.value.decode(raw.reshape(offered.num_rows, -1), offered.column("cell").to_numpy())

    coded = index.rows.mapInArrow(encode, "id string, tie long, cell int, ring int, part int, code binary")
    rings = spark.sparkContext.broadcast(index.rings)
    asked = _bounded(queries, least - slack)
    # a ring must be able to hold a score of `least`; every ring that can is read
    visits = asked.mapInArrow(_visits(rings, 1 << 62, least, False), _VISIT).where(F.col("ring").isNotNull())
    hits = _read(written(visits, "visits"), index, coded, per_result * k, per_block, decode)
    return _ranked(hits, per_result * k).select("query_id", "id", "tie")


def rescored(candidates: DataFrame, queries: DataFrame, rows: DataFrame, k: int, least: float) -> DataFrame:
    """The k best of the candidates by their exact cosine, ``least`` at least."""
    def total(pairs):
        return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)

    def norm(c):  # once for each vector, not for each pair
        return F.sqrt(total(F.transform(F.col(c).cast("array<double>"), lambda x: x * x)))

    asked = queries.select("query_id", "query_embedding", norm("query_embedding").alias("a_norm"))
    offered = rows.select("id", "embedding", norm("embedding").alias("b_norm"))
    both = candidates.join(asked, "query_id").join(offered, "id")
    a, b = F.col("query_embedding").cast("array<double>"), F.col("embedding").cast("array<double>")
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norms = F.col("a_norm") * F.col("b_norm")
    scored = both.select("query_id", "id", "tie", F.round(dot / norms, 9).alias("score")).where(F.col("score") >= least)
    return _ranked(scored, k).select("query_id", "id", "score", "rank")


# --- shared buckets ----------------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _score_buckets(k: int, least: float):
    """Best k rows of a part for each query of a block, among those that share a bucket with it.

    Scores in single precision choose the pairs that can be among them, those are then scored in double precision.
    """

    def run(asked: pa.Table, offered: pa.Table) -> pa.Table:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        ids = offered.column("key").to_numpy()
        if asked.num_rows and offered.num_rows:
            queries, vectors = _matrix(asked.column("unit")), _matrix(offered.column("unit"))
            wanted, buckets = _matrix(asked.column("buckets")), _matrix(offered.column("buckets"))
            # 1 less half the squared distance, as a product; vectors without direction stay zero
            here, there = 0.5 - 0.5 * (vectors**2).sum(axis=1), 0.5 - 0.5 * (queries**2).sum(axis=1)
            vectors = np.column_stack([vectors, here, np.ones(len(vectors))])
            queries = np.column_stack([queries, np.ones(len(queries)), there])
            rough, rough_queries = vectors.astype(np.float32), queries.astype(np.float32).T.copy()
            place = np.argsort(np.argsort(ids, kind="stable"))
            bound = np.full(len(queries), least - 1e-5, np.float32)
            for at in range(0, len(vectors), 512):
                rows, columns = np.nonzero(rough[at : at + 512] @ rough_queries >= bound)
                for x in range(0, len(rows), PAIRS):
                    row, query = rows[x : x + PAIRS] + at, columns[x : x + PAIRS]
                    shared = (buckets[row] == wanted[query]).any(axis=1)
                    row, query = row[shared], query[shared]
                    score = np.round(np.einsum("ij,ij->i", vectors[row], queries[query]), 9)
                    kept = score >= least
                    new = (query[kept], row[kept], score[kept])
                    held = _best_of([np.concatenate(pair) for pair in zip(held, new)], place, k)
                full = np.bincount(held[0], minlength=len(queries)) >= k
                lowest = np.full(len(queries), np.inf)
                np.minimum.at(lowest, held[0], held[2])
                bound[full] = lowest[full] - 1e-5
        query, row, score = held
        arrays = [pa.array(asked.column("key").to_numpy()[query], pa.int64()), pa.array(ids[row], pa.string())]
        arrays += [pa.array(np.zeros(len(row), np.int64)), pa.array(score, pa.float64())]
        return pa.Table.from_arrays(arrays, names=["query_id", "id", "tie", "score"])

    return run


def bucket_hits(
    asked: DataFrame, rows: DataFrame, k: int, least: float, per_block: int = QUERIES_PER_BLOCK, unit_bytes: int = UNIT_BYTES
) -> DataFrame:
    """(query_id, id, tie, score) of rows that share a bucket with a query, the k best of every part of the rows.

    ``asked`` and ``rows`` have (key, unit, buckets): a unit vector and its bucket in each table.
    """
    total, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("unit")), F.lit(1))).first()
    parts = max(1, -(-total * 8 * max(1, width) // unit_bytes))
    blocks = max(1, -(-asked.count() // per_block))

    def dealt(df: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64("key"), F.lit(count)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).groupBy("part", "block")

    left, right = dealt(asked, "block", blocks, "part", parts), dealt(rows, "part", parts, "block", blocks)
    return left.cogroup(right).applyInArrow(_score_buckets(k, least), HIT)
