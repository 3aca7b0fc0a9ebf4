"""Chat messages to chunks: low-value filter, day and gap sessions, size caps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from loreframe.functions import text as tx
from loreframe.functions.constants import LOW_VALUE_CONTENTS, LOW_VALUE_SPEAKER
from loreframe.scale import position_and_previous, previous_value, running_sum
from loreframe.session import cut_lineage, written

MINUTE = "yyyy-MM-dd HH:mm"


def drop_low_value(messages: DataFrame) -> DataFrame:
    return messages.filter(
        (F.col("speaker") != LOW_VALUE_SPEAKER) & ~tx.strip("content").isin(LOW_VALUE_CONTENTS)
    )


def _order():
    return [F.col("sent_at"), F.col("pos")]


def gap_sessions(messages: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Adds ``session``: it grows where the silence before a message is longer than the gap.

    Both steps work inside (channel, day) buckets plus a small carry per bucket, so one busy
    channel spreads over as many tasks as it has days.
    """
    kept = drop_low_value(messages)
    day = F.to_date("sent_at")
    seen = previous_value(kept, ["channel"], day, _order(), F.col("sent_at"), "prev")
    silence = F.unix_micros(F.col("sent_at").cast("timestamp")) - F.unix_micros(
        F.col("prev").cast("timestamp")
    )
    opened = seen.withColumn(
        "opens", F.when(F.col("prev").isNull() | (silence > gap_minutes * 60_000_000), 1).otherwise(0)
    )
    return running_sum(
        opened, ["channel"], F.to_date("sent_at"), _order(), F.col("opens"), "session"
    ).drop("opens", "prev")


def day_sessions(messages: DataFrame, days: int = 1) -> DataFrame:
    """Adds ``session``: the first day of the chunk a message belongs to.

    A chunk spans ``days`` days from its own first message, so the fold runs over the distinct
    days of a channel only, never over its messages.
    """
    days = min(max(int(days), 1), 7)
    kept = drop_low_value(messages).withColumn("day", F.to_date("sent_at"))
    if days == 1:
        return kept.withColumnRenamed("day", "session")
    starts = kept.groupBy("channel").agg(F.sort_array(F.collect_set("day")).alias("seen"))
    fold = F.aggregate(
        F.slice("seen", F.lit(2), F.size("seen")),
        F.array(F.struct(F.get("seen", F.lit(0)).alias("day"), F.get("seen", F.lit(0)).alias("session"))),
        lambda acc, d: F.array_append(
            acc,
            F.struct(
                d.alias("day"),
                F.when(
                    F.datediff(d, F.element_at(acc, -1)["session"]) < days,
                    F.element_at(acc, -1)["session"],
                )
                .otherwise(d)
                .alias("session"),
            ),
        ),
    )
    mapping = starts.select("channel", F.inline(fold))
    return kept.join(mapping, ["channel", "day"]).drop("day")


def build_chunks(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """First and last time, message count, joined text and keywords per chunk."""
    line = F.concat(
        F.lit("["), F.date_format("sent_at", MINUTE), F.lit("] "), "speaker", F.lit(": "), "content"
    )
    rows = F.sort_array(F.collect_list(F.struct("sent_at", "pos", line.alias("line"))))
    text = F.array_join(F.transform(rows, lambda r: r["line"]), "\n")
    built = sessions.groupBy(*keys).agg(
        F.min("sent_at").alias("start_at"),
        F.max("sent_at").alias("end_at"),
        F.count(F.lit(1)).alias("message_count"),
        text.alias("text"),
    )
    return built.withColumn("keywords", tx.chat_keywords(F.col("text")))


def chunk_parts(
    messages: DataFrame,
    gap_minutes: int | None = None,
    days: int = 1,
    max_messages: int = 120,
    max_chars: int = 8000,
    block: int = 1024,
) -> DataFrame:
    """Adds ``part``, the number of a message's chunk in its channel.

    A chunk ends at a silence longer than ``gap_minutes`` or, without that, once ``days`` days have
    passed since its own first message; and in either case at the size caps. A chunk that a cap
    opened starts a day window of its own.
    """
    marked = drop_low_value(messages)
    if gap_minutes is not None:
        return _parts(marked, ["channel"], 1, max_messages, max_chars, block, gap_minutes)
    # messages without a time come first and share one window
    day = F.coalesce(F.unix_date(F.to_date("sent_at")).cast("long"), F.lit(-(1 << 40)))
    reach = min(max(int(days), 1), 7)
    return _parts(marked.withColumn("mark", day), ["channel"], reach, max_messages, max_chars, block)


def capped_sessions(
    sessions: DataFrame, max_messages: int = 120, max_chars: int = 8000, block: int = 1024
) -> DataFrame:
    """Adds ``part`` inside each given session: greedy size caps."""
    marked = sessions.withColumn("mark", F.lit(0).cast("long"))
    return _parts(marked, ["channel", "session"], 1, max_messages, max_chars, block)


def _part_ends(size: np.ndarray, mark: np.ndarray, reach: int, max_messages: int, max_chars: int) -> np.ndarray:
    """Where a part that starts at each row ends: within reach of its first mark, and of the caps."""
    used = np.concatenate([[0], np.cumsum(size)])
    begin = np.arange(len(size))
    by_chars = np.maximum(np.searchsorted(used, used[begin] + max_chars, side="right") - 1, begin + 1)
    by_mark = np.searchsorted(mark, mark + reach, side="left")
    return np.minimum(np.minimum(by_chars, by_mark), np.minimum(begin + max_messages, len(size)))


def _matched(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi join on keys in which null equals null."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"__{k}" for k in keys])


def _fold_blocks(rows: DataFrame, ids: list[str], fold: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> DataFrame:
    """(ids, n, nth): ``fold(size, mark, entry)`` of each block's rows in order, many blocks in one Arrow batch."""
    kinds = [rows.schema[c] for c in [*ids, "n"]]
    schema = T.StructType([*kinds, T.StructField("nth", T.LongType())])

    def begins(table: pa.Table) -> np.ndarray:
        differs = np.zeros(table.num_rows, bool)
        differs[0] = True
        for c in ids:
            column = table.column(c).combine_chunks()
            a, b = column.slice(0, len(column) - 1), column.slice(1)
            unlike = pc.fill_null(pc.not_equal(a, b), True)
            both = pc.and_(pc.is_null(a), pc.is_null(b))
            differs[1:] |= pc.and_not(unlike, both).to_numpy(zero_copy_only=False)
        return np.flatnonzero(differs)

    def folded(table: pa.Table) -> pa.Table:
        size, mark, entry = (table.column(c).to_numpy() for c in ("size", "mark", "entry"))
        edge = [*begins(table).tolist(), table.num_rows]
        nth = [fold(size[a:b], mark[a:b], int(entry[a])) for a, b in zip(edge, edge[1:])]
        return table.select([*ids, "n"]).append_column("nth", pa.array(np.concatenate(nth), pa.int64()))

    def run(batches):
        rest = None  # the last block, as its rows may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            last = int(begins(table)[-1])
            if last:
                yield from folded(table.slice(0, last)).combine_chunks().to_batches()
            rest = table.slice(last)
        if rest is not None:
            yield from folded(rest).combine_chunks().to_batches()

    dealt = rows.repartition(*[F.col(c) for c in ids]).sortWithinPartitions(*ids, "n")
    return dealt.mapInArrow(run, schema)


def _parts(
    marked: DataFrame,
    keys: list[str],
    reach: int,
    max_messages: int,
    max_chars: int,
    block: int,
    gap_minutes: int | None = None,
) -> DataFrame:
    """Greedy parts per key, exact and without one task per key; ``marked`` has ``mark`` unless a gap is given.

    Where the next part starts depends only on where the current one started, and a part reaches at
    most ``max_messages`` rows ahead. A key's rows are cut into blocks at least that long. Every block
    follows each of its possible entry rows to its end (in parallel, seeing the rows it may overrun),
    which gives a short entry -> exit list per block; these lists are chained in groups, groups of
    groups and so on, to the true entry of every block. Each block then counts its own part starts.
    Keys without a second block, the common case, need none of the lists.
    """
    block = max(block, max_messages)
    ids = [*keys, "blk"]
    placed = position_and_previous(marked, keys, F.to_date("sent_at"), _order(), F.col("sent_at"), "n", "__prev")
    if gap_minutes is not None:
        micros = [F.unix_micros(F.col(c).cast("timestamp")) for c in ("sent_at", "__prev")]
        apart = F.col("__prev").isNull() | (micros[0] - micros[1] > gap_minutes * 60_000_000)
        placed = placed.withColumn("mark", F.when(apart, 1).otherwise(0).cast("long"))
    n = F.col("n") - 1
    placed = written(placed.drop("__prev").withColumns({"n": n, "blk": F.floor(n / block)}), "placed")
    size = F.coalesce(F.length("content"), F.lit(0)) + F.coalesce(F.length("speaker"), F.lit(0)) + 20
    rows = placed.select(*ids, "n", size.cast("long").alias("size"), "mark")

    def ends(size: np.ndarray, mark: np.ndarray) -> np.ndarray:
        # with a gap, the mark of a row is the number of silences before it
        return _part_ends(size, mark if gap_minutes is None else np.cumsum(mark), reach, max_messages, max_chars)

    def starts(size: np.ndarray, mark: np.ndarray, at: int) -> np.ndarray:
        end, opens = ends(size, mark), np.zeros(len(size), np.int64)
        while at < len(size):
            opens[at] = 1
            at = int(end[at])
        return np.cumsum(opens)

    entered = rows.withColumn("entry", F.lit(0).cast("long"))
    if not rows.filter("blk > 0").isEmpty():
        entries = _block_entries(rows, keys, ends, max_messages, block)
        entered = _matched(rows, entries, ids, "left").fillna(0, ["entry"])
    counted = written(_fold_blocks(entered, ids, starts), "parts")
    before = W.partitionBy(*keys).orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    begun = counted.groupBy(*ids).agg(F.max("nth").alias("begun"))
    earlier = begun.select(*ids, F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("earlier"))
    parts = _matched(counted, earlier, ids, "inner").select(*keys, "n", (F.col("nth") + F.col("earlier")).alias("part"))
    return _matched(placed.drop("blk", "mark"), parts, [*keys, "n"], "inner").drop("n")


def _block_entries(rows: DataFrame, keys: list[str], ends: Callable, max_messages: int, block: int) -> DataFrame:
    """(keys, blk, entry): first part start of each later block of keys with several blocks."""
    long_keys = rows.filter(F.col("blk") > 0).select(*keys).distinct()
    mine = _matched(rows, long_keys, keys, "inner")
    ahead = mine.filter((F.col("n") % block < max_messages) & (F.col("blk") > 0)).withColumn(
        "blk", F.col("blk") - 1
    )

    def exits(key, pdf):
        pdf = pdf.sort_values("n")
        end = ends(pdf["size"].to_numpy(), pdf["mark"].to_numpy())
        own = min(block, len(end))
        out = np.arange(own + max_messages)
        for i in range(own - 1, -1, -1):
            out[i] = end[i] if end[i] >= own else out[end[i]]
        return pd.DataFrame(
            {**dict(zip(keys, key[:-1])), "blk": key[-1], "exits": [(out[: min(max_messages, own)] - own).tolist()]}
        )

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    lists = mine.unionByName(ahead).groupBy(*keys, "blk").applyInPandas(exits, f"{kinds}, blk long, exits array<long>")
    return _chain(cut_lineage(lists), keys, kinds)


def _follow(exits: list, entry: int) -> tuple[list[int], int]:
    """Entry of each block of a run, and the exit of the last one."""
    found = []
    for jump in exits:
        found.append(entry)
        entry = int(jump[entry]) if entry < len(jump) else 0
    return found, entry


def _chain(lists: DataFrame, keys: list[str], kinds: str, fan: int = 512) -> DataFrame:
    """(keys, blk, entry) from each block's entry -> exit list, by runs of ``fan`` blocks."""
    last = lists.agg(F.max("blk")).first()[0] or 0
    runs = lists.withColumn("run", F.floor(F.col("blk") / fan))
    entries = lists.sparkSession.createDataFrame([], f"{kinds}, run long, entry long")
    if last >= fan:

        def composed(key, pdf):
            ordered = pdf.sort_values("blk")["exits"].tolist()
            jumps = [_follow(ordered, e)[1] for e in range(len(ordered[0]))]
            return pd.DataFrame({**dict(zip(keys, key[:-1])), "blk": key[-1], "exits": [jumps]})

        joined = runs.groupBy(*keys, "run").applyInPandas(composed, f"{kinds}, blk long, exits array<long>")
        entries = _chain(cut_lineage(joined), keys, kinds, fan).withColumnRenamed("blk", "run")

    def entered(key, pdf):
        pdf = pdf.sort_values("blk")
        found, _ = _follow(pdf["exits"].tolist(), int(pdf["entry"].iloc[0]))
        return pd.DataFrame({**dict(zip(keys, key[:-1])), "blk": pdf["blk"].to_numpy(), "entry": found})

    begun = _matched(runs, entries, [*keys, "run"], "left").fillna(0, ["entry"])
    return begun.groupBy(*keys, "run").applyInPandas(entered, f"{kinds}, blk long, entry long")
