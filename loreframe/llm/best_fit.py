"""Best-fit packing in bulk-synchronous rounds.

Documents longer than a sequence are cut into full pieces and a rest; what has to be fitted are the pieces'
lengths. Pieces of one length are interchangeable, and so are sequences with the same room left, so both are kept
as runs (size, count, first number), pre-aggregated before anything is shuffled: a round moves at most a few runs
for each length, whatever the number of documents.

A round range-sorts the runs of lengths and of gaps together. Each range is swept in ascending order with a stack:
a gap's best fit is the longest piece not yet taken that is no longer than the gap, and each length's successor is
the smallest gap that no longer one needs. Within a run the number decides who goes first: the lowest numbers of
the shorter run are matched, the rest of the longer run stays for the next partner. What a range cannot match
within itself, gaps below all its lengths and lengths above all its gaps, is swept once more across the ranges.
Gaps are then updated and the next round begins. Lengths take part in falling tiers, as best-fit decreasing does;
where no length of the tier fits any gap, new sequences are opened.

The rounds yield the plan: which numbers of a length go where. Every piece then reads its place from it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from loreframe.llm.tables import empty_like
from loreframe.llm.wordarrays import slices
from loreframe.session import written

RANGES = 8  # parts that a round's sweep is dealt over
FEW_RUNS = 256  # with fewer lengths left in a tier, one task goes through its remaining rounds
PLAN_ROWS = 1 << 20  # a longer plan is joined instead of broadcast

PIECES, GAPS, UPDATED, PLACED = range(4)
RUN = "kind int, size long, n long, first long, sequence long, per long, offset long"
_NAMES = ["kind", "size", "n", "first", "sequence", "per", "offset"]


def _sweep(runs: list[tuple[int, int, int, int]], window: int) -> list[tuple]:
    """One sweep over (kind, size, n, first) runs: placements, updated gaps, and what found no partner."""
    out, stack = [], []
    for kind, size, n, first in sorted(runs, key=lambda r: (r[1], r[0], r[3])):
        if kind == PIECES:
            stack.append([size, n, first])
            continue
        while n and stack:
            length, left, at = stack[-1]
            per = min(size // length, left)  # pieces of this length that one gap takes
            bins = min(n, left // per)
            out.append((PLACED, length, bins * per, at, first, per, window - size))
            out.append((UPDATED, size - per * length, bins, first, None, None, None))
            n, first = n - bins, first + bins
            stack[-1][1:] = left - bins * per, at + bins * per
            if not stack[-1][1]:
                stack.pop()
        if n:
            out.append((GAPS, size, n, first, None, None, None))
    return out + [(PIECES, *run, None, None, None) for run in stack]


def _rows(batches: Iterator[pa.RecordBatch]) -> list[tuple]:
    return [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in _NAMES))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=_NAMES)


def _sweep_range(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _batch(_sweep([r[:4] for r in _rows(batches)], window))

    return run


def _sweep_rest(window: int):
    """Sweeps what the ranges left; gaps updated in this round rest until the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _rows(batches)
        swept = _sweep([r[:4] for r in rows if r[0] in (PIECES, GAPS)], window)
        yield _batch([r for r in rows if r[0] == UPDATED] + swept)

    return run


def _opened(pieces: list[tuple[int, int]], window: int) -> int:
    """New sequences that ``pieces`` (length, n) need at least: none fits a gap."""
    alone = sum(n for length, n in pieces if 2 * length > window)
    return max(alone, -(-sum(length * n for length, n in pieces) // window))


def _finish(window: int, unused: int):
    """All remaining rounds of a tier with few lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, placed, following = [r[:4] for r in _rows(batches)], [], unused
        while any(r[0] == PIECES for r in runs):
            pieces = [(r[1], r[2]) for r in runs if r[0] == PIECES]
            if min(pieces)[0] > max((r[1] for r in runs if r[0] == GAPS), default=0):
                count = _opened(pieces, window)
                runs.append((GAPS, window, count, following))
                following += count
            swept = _sweep(runs, window)
            placed += [r for r in swept if r[0] == PLACED]
            runs = [(GAPS if r[0] == UPDATED else r[0], *r[1:4]) for r in swept if r[0] != PLACED]
        yield _batch(placed + [(*r, None, None, None) for r in runs])

    return run


def _state(runs: DataFrame) -> DataFrame:
    """Pieces and gaps of the next round; full sequences and placements leave."""
    kind = F.when(F.col("kind") == UPDATED, GAPS).otherwise(F.col("kind"))
    return runs.where((F.col("kind") != PLACED) & (F.col("size") > 0)).withColumn("kind", kind)


def plan_best_fit(lengths: DataFrame, window: int, ranges: int = RANGES, few_runs: int = FEW_RUNS) -> DataFrame:
    """The plan (length, first, n, sequence, per, offset) for ``lengths(length, n)``, all from 1 to ``window``.

    Pieces ``first`` to ``first + n - 1`` of a length go to sequences from ``sequence`` on, ``per`` in each, the
    first of them at ``offset``. Sequence numbers are not gapless.
    """
    spark = lengths.sparkSession
    nothing = [F.lit(None).cast("long").alias(c) for c in ("sequence", "per", "offset")]
    every = lengths.select(F.lit(PIECES).alias("kind"), F.col("length").alias("size"), "n", F.lit(0).cast("long").alias("first"), *nothing)
    state, plans, unused = empty_like(spark, RUN), [], 0
    tiers = [window, *[window // part for part in (2, 3, 4, 6, 8, 16)], 0]
    for high, low in zip(tiers[:-1], tiers[1:]):
        state = state.union(every.where((F.col("size") > low) & (F.col("size") <= high)))
        while True:
            state = written(state, "runs")
            is_piece, is_gap = F.col("kind") == PIECES, F.col("kind") == GAPS
            seen = state.agg(
                F.count_if(is_piece).alias("pieces"),
                F.min(F.when(is_piece, F.col("size"))).alias("shortest"),
                F.max(F.when(is_gap, F.col("size"))).alias("widest"),
                F.sum(F.when(is_piece, F.col("size") * F.col("n"))).alias("tokens"),
                F.sum(F.when(is_piece & (2 * F.col("size") > window), F.col("n"))).alias("alone"),
            ).first()
            if not seen["pieces"]:
                break
            if seen["pieces"] <= few_runs:
                ended = written(state.coalesce(1).mapInArrow(_finish(window, unused), RUN), "round")
                plans.append(ended)
                state = _state(ended)
                unused = max(unused, _upto(ended))
                break
            if seen["shortest"] > (seen["widest"] or 0):
                count = max(seen["alone"] or 0, -(-seen["tokens"] // window))
                state = state.union(spark.createDataFrame([(GAPS, window, count, unused, None, None, None)], RUN))
                unused += count
            swept = written(state.repartitionByRange(ranges, "size").mapInArrow(_sweep_range(window), RUN), "sweep")
            rest = written(swept.where(F.col("kind") != PLACED).coalesce(1).mapInArrow(_sweep_rest(window), RUN), "round")
            plans += [swept, rest]
            state = _state(rest)
    placed = empty_like(spark, RUN)
    for plan in plans:
        placed = placed.union(plan.where(F.col("kind") == PLACED))
    return placed.select(F.col("size").alias("length"), "first", "n", "sequence", "per", "offset")


def _upto(runs: DataFrame) -> int:
    """The smallest sequence number that no run has used."""
    ends = F.when(F.col("kind") == PLACED, F.expr("sequence + n div per")).otherwise(F.col("first") + F.col("n"))
    return int(runs.where(F.col("kind") != PIECES).agg(F.coalesce(F.max(ends), F.lit(0))).first()[0])


def _tokenize(encoder: Callable[[], Callable[[pa.Array], list[np.ndarray]]], end_id: int, window: int, with_ids: bool, stretch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", stretch):
                row, piece, length, crc, kept = [], [], [], [], []
                for i, ids in enumerate(encode(batch.column("text"))):
                    ids = np.append(ids, np.array(end_id, ids.dtype)).astype("<u4")
                    for k in range(-(-len(ids) // window)):
                        cut = ids[k * window : (k + 1) * window].tobytes()
                        row.append(i)
                        piece.append(k)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            kept.append(cut)
                sizes = np.array(length, np.int64)
                order = np.argsort(sizes, kind="stable")
                nth = np.empty(len(sizes), np.int64)
                nth[order] = np.arange(len(sizes)) - np.searchsorted(sizes[order], sizes[order]) + seen[sizes[order]]
                seen += np.bincount(sizes, minlength=window + 1)
                arrays = [batch.column("doc_id").take(pa.array(row, pa.int64()))]
                arrays += [pa.array(x, pa.int64()) for x in (np.full(len(row), part), piece, sizes, crc, nth)]
                names = ["doc_id", "part", "piece", "length", "ids_crc32", "nth"]
                if with_ids:
                    arrays.append(pa.array(kept, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def _place(plan: Broadcast, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, rows = plan.value
        for batch in batches:
            sequence, offset = [], []
            for length, number in zip(batch.column("length").to_pylist(), batch.column("number").to_pylist()):
                _, first, _, begin, per, base = rows[bisect_right(starts, (length, number)) - 1]
                sequence.append(begin + (number - first) // per)
                offset.append(base + (number - first) % per * length)
            arrays = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*columns, "sequence_id", "offset"])

    return run


def pack_best_fit(
    docs: DataFrame,
    encoder: Callable[[], Callable[[pa.Array], list[np.ndarray]]],
    end_id: int,
    window: int = 4096,
    with_ids: bool = False,
    stretch: int = 1 << 23,
) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ``ids``
    (32-bit little-endian) if ``with_ids``.

    ``encoder()`` is called once in each task and gives the function from texts to id arrays; ``end_id`` closes each
    document, so a null or empty text is one piece of length 1. Only documents longer than ``window`` are cut, into
    full pieces and a rest. No sequence is longer than ``window``, offsets inside one have no gaps, sequence numbers
    may have some. A row is one document, also when its doc_id is null or repeated. Other columns are ignored. An
    empty table gives no pieces.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = written(
        docs.select("doc_id", "text").mapInArrow(
            _tokenize(encoder, end_id, window, with_ids, stretch),
            f"doc_id {kind}, part long, piece long, length long, ids_crc32 long, nth long" + ", ids binary" * with_ids,
        ),
        "pieces",
    )
    # numbers of a length run over the parts of the input one after another
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    plan = written(plan_best_fit(counts.groupBy("length").agg(F.sum("n").alias("n")), window), "plan")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    numbered = pieces.join(bases, ["part", "length"]).select(
        *[F.col(c) for c in columns if c != "start"],
        (F.col("piece") * window).alias("start"),
        (F.col("base") + F.col("nth")).alias("number"),
    )
    out = [c for c in columns if c != "ids"] + ["sequence_id", "offset"] + ["ids"] * with_ids
    if plan.count() > PLAN_ROWS:
        at = F.col("number") - F.col("first")
        found = numbered.join(plan, "length").where((at >= 0) & (at < F.col("n")))
        sequence = F.col("sequence") + F.floor(at / F.col("per"))
        placed = found.select(*columns, sequence.alias("sequence_id"), (F.col("offset") + at % F.col("per") * F.col("length")).alias("offset"))
        return placed.select(*out)
    rows = sorted(tuple(r) for r in plan.collect())
    held = spark.sparkContext.broadcast(([r[:2] for r in rows], rows))
    ids = ", ids binary" * with_ids
    schema = f"doc_id {kind}, piece long, start long, length long, ids_crc32 long{ids}, sequence_id long, offset long"
    return numbered.select(*columns, "number").mapInArrow(_place(held, columns), schema).select(*out)
