"""Set similarity join on word n-grams: every pair of texts with Jaccard similarity of the threshold.

Size-aware heavy-light join. Texts with equal sets are one node. For each node, keys are made such
that two similar nodes share one:

* light nodes (few n-grams) enumerate fixed-size subsets of their set: a pair of sizes (s, t) needs an
  overlap of o(s, t), so both list all their subsets of o(s, t) n-grams;
* heavy nodes go into the inverted lists of their first n-grams, frequent ones last, as many as a
  similar partner cannot all miss. Light nodes just below the boundary go there too.

The boundary is the set size with the least total of enumerated subsets below and scanned list
entries above it, both counted over the whole input.

A heavy node whose lists are not frequent goes into SHARED - 1 further ones; it is ``strong``. Two strong nodes that match
share SHARED n-grams of their lists, or all that a match needs, if that is fewer. Such a pair of short lists is compared
only if it meets in so many of them: if one of the shared lists is longer, that list links the pair.

A short list is compared pair by pair, first by the n-grams that made the lists, then by whole sets. A longer one is
scanned without comparing all its pairs, against a reference set ``m``: the n-grams that most of some of its members
have. Any set would give right results; a typical one leaves little to do. Let e(x) be the number of n-grams in which x and m differ, and
w(x) = r|x| - e(x) with r = (100 - percent) / (100 + percent). Two sets match when they differ in at most
r(|x| + |y|) n-grams, and x and y differ in e(x) + e(y) - 2k, where k counts the differences from m that
they have in common. So they match exactly when w(x) + w(y) + 2k >= 0. Let c be the member with the
largest w.

* If w(x) + w(c) >= 0, then x and c match, whatever they have in common: x is linked with c.
* Two members that are both linked with c need no comparison.
* If y is not linked with c, it matches x only if k >= -(w(x) + w(y)) / 2 > 0. So both go on to lists keyed
  by m and their first differences from m (an n-gram more or one less), the rare ones first, as many as two
  sets with that much in common cannot both miss. A list without such a y is done.

Members of such a list differ from m in few n-grams, so up to BLOCK of them are compared in one task from
their differences alone; a longer list gets a reference of its own.

Work follows the length of the lists, not its square, and no link between components is lost.

Hashes of n-grams and sets have 64 bits; two different n-grams meet with a chance of n*n/2**65.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loreframe.llm.tables import components, empty_like
from loreframe.llm.wordarrays import give_back, mix, shingles, slices, sorted_sets, text_bytes, word_hashes
from loreframe.session import written

LIGHT_SIZES = 32  # sizes up to this one are tried as the boundary
SHARED = 4  # n-grams of their lists that a pair of strong nodes must share
SHORT_LIST = 32  # lists up to this length are compared pair by pair
REFERENCE_FROM = 9  # so many members of a longer list make its reference set
LEADERS = 2  # lists with the same so many first members share their reference set
BITMAP = 1 << 24  # bits of the filter that keeps unneeded sets from being moved
BLOCK = 1024  # lists of differences up to this length are compared in one task
FREQUENT_AT = 24  # a list is frequent from this length on ...
FREQUENT_MOST = 1 << 18  # ... or longer, so that at most this many lists are frequent


def overlap_needed(s: int, t: int, percent: int) -> int:
    """Least overlap of sets of sizes s and t for a similarity of percent/100."""
    return -(-percent * (s + t) // (100 + percent))


def prefix_length(size: np.ndarray | int, percent: int):
    """How many n-grams of a set a similar partner cannot all miss."""
    return size - -(-percent * size // 100) + 1


def subset_sizes(s: int, percent: int) -> list[int]:
    """Sizes of the subsets that a set of s n-grams enumerates, one for each fitting partner size."""
    fits = [t for t in range(-(-percent * s // 100), 100 * s // percent + 1) if t > 0]
    return sorted({overlap_needed(s, t, percent) for t in fits})


def subset_count(s: int, percent: int) -> int:
    return sum(math.comb(s, c) for c in subset_sizes(s, percent))


def _sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    words, offsets = word_hashes(*text_bytes(batch.column("text")))
    return sorted_sets(*shingles(words, offsets, size))


def _node(members: np.ndarray) -> int:
    return int.from_bytes(blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


def _by_order(members: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The sorted set with its frequent n-grams last."""
    if not len(frequent):
        return members
    at = np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)
    late = frequent[at] == members
    return np.concatenate([members[~late], members[late]]) if late.any() else members


def _lists(values: list[np.ndarray]) -> pa.Array:
    lengths = np.array([0, *map(len, values)], np.int64).cumsum().astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat.view(np.int64)))


def _describe(size: int, percent: int):
    """Per text: its node, set size and first n-grams by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                values, offsets = _sets(batch, size)
                members = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([_node(m) if len(m) else None for m in members], pa.int64()),
                        pa.array([len(m) for m in members], pa.int64()),
                        _lists([m[: prefix_length(len(m), percent)] for m in members]),
                    ],
                    names=["doc_id", "node", "n_shingles", "first"],
                )

    return run


def _members(size: int, wanted):
    """Per text: its whole sorted set, if its node may be one of those asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = wanted.value
        for whole in batches:
            for batch in slices(whole, "text"):
                values, offsets = _sets(batch, size)
                nodes, kept = [], []
                for a, b in zip(offsets[:-1], offsets[1:]):
                    if a < b:
                        node = _node(values[a:b])
                        bit = node & (BITMAP - 1)
                        if int(words[bit >> 6]) >> (bit & 63) & 1:
                            nodes.append(node)
                            kept.append(values[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _lists(kept)], names=["node", "members"])

    return run


def _among(wanted):
    """The rows whose ``node`` may be one of those asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = wanted.value
        for batch in batches:
            bit = batch.column("node").to_numpy() & (BITMAP - 1)
            yield batch.filter(pa.array((words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1))

    return run


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """BITMAP bits, with the one of each node set; a prefilter of fixed size, an exact join follows."""
    bit = F.col("node").bitwiseAND(F.lit(BITMAP - 1))
    words = nodes.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(node & 63 as int))").alias("bits"))
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()
    out = np.zeros(BITMAP >> 6, np.int64)
    out[[r["word"] for r in found]] = [r["bits"] for r in found]
    return out.view(np.uint64)


def _entries(size: int, percent: int, boundary: int, frequent):
    """List entries (list, node, n, strong) of every text by its class; ``many`` where the list is frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        for whole in batches:
            for batch in slices(whole, "text"):
                values, offsets = _sets(batch, size)
                keys, nodes, sizes, strong, many = [], [], [], [], []
                for a, b in zip(offsets[:-1], offsets[1:]):
                    n = int(b - a)
                    if not n:
                        continue
                    members = values[a:b]
                    own = []
                    if n < boundary:
                        for c in subset_sizes(n, percent):
                            chosen = np.array(list(combinations(range(n), c)), np.int64)
                            key = np.full(len(chosen), c, np.uint64) * np.uint64(0xD1B54A32D192ED03)
                            for k in range(c):
                                key = mix(key + members[chosen[:, k]])
                            own.append(key)
                    further = False
                    if 100 * n >= percent * boundary:
                        first = _by_order(members, late)[: prefix_length(n, percent) + SHARED - 1]
                        further = n >= boundary and not _in(first, late).any()
                        own.append(first if further else first[: prefix_length(n, percent)])
                    key = np.concatenate(own)
                    keys.append(key)
                    nodes.append(np.full(len(key), _node(members), np.int64))
                    sizes.append(np.full(len(key), n, np.int64))
                    strong.append(np.full(len(key), further))
                    many.append(_in(key, late))
                if keys:
                    arrays = [pa.array(np.concatenate(x).view(np.int64)) for x in (keys, nodes, sizes)]
                    arrays += [pa.array(np.concatenate(x)) for x in (strong, many)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["list", "node", "n", "strong", "many"])

    return run


def _two_sets(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    columns = []
    for name in ("x_set", "m_set"):
        column = batch.column(name)
        columns.append((column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()))
    (x_flat, x_at), (m_flat, m_at) = columns
    for i in range(batch.num_rows):
        yield x_flat[x_at[i] : x_at[i + 1]], m_flat[m_at[i] : m_at[i + 1]]


def _in(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which members of x are in the sorted set m."""
    return m[np.minimum(np.searchsorted(m, x), len(m) - 1)] == x if len(m) else np.zeros(len(x), bool)


def _possible(percent: int):
    """The pairs that their first n-grams by hash do not rule out.

    Up to the smaller of the two last ones both sets are known, so what differs there differs in all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            sizes = zip(batch.column("x_n").to_pylist(), batch.column("m_n").to_pylist())
            for (x, m), (x_n, m_n) in zip(_two_sets(batch), sizes):
                bound = min(x[-1], m[-1])
                x, m = x[: np.searchsorted(x, bound, "right")], m[: np.searchsorted(m, bound, "right")]
                apart = len(x) + len(m) - 2 * int(_in(x, m).sum())
                keep.append((100 + percent) * apart <= (100 - percent) * (x_n + m_n))
            yield batch.select(["m", "x"]).filter(pa.array(keep, pa.bool_()))

    return run


def _match(percent: int):
    """The pairs (a, b) of nodes that match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            match = []
            for x, m in _two_sets(batch):
                common = int(_in(x, m).sum())
                match.append(100 * common >= percent * (len(x) + len(m) - common))
            yield batch.select(["m", "x"]).filter(pa.array(match, pa.bool_()))
            give_back()

    return run


def _differences(frequent):
    """Per (m, x): e(x) and the differences from m, the rare ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        for batch in batches:
            total, differences = [], []
            for x, m in _two_sets(batch):
                plus, minus = _by_order(x[~_in(x, m)], late), m[~_in(m, x)]
                total.append(len(plus) + len(minus))
                # one more scrambling tells a missing n-gram from a further one
                differences.append(np.concatenate([plus, mix(minus)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("m"), batch.column("x"), batch.column("n"), pa.array(total, pa.int64()), _lists(differences)],
                names=["m", "x", "n", "e", "differences"],
            )
            give_back()

    return run


def _band(n: Column, percent: int) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent) + 1e-9).cast("int")


def _banded(entries: DataFrame, percent: int) -> DataFrame:
    """Each entry in two size bands; two sets that can match meet in the ``own`` band of the larger one."""
    band = _band(F.col("n"), percent)
    return entries.select("*", F.posexplode(F.array(band, band + 1)).alias("own", "band")).withColumn("own", F.col("own") == 0)


def _live_members(entries: DataFrame, percent: int) -> DataFrame:
    """Members of lists that can still link something, with the length of their list.

    A list in whose band no set has its own one holds only pairs that meet in the band before.
    """
    held = _banded(entries, percent)
    lists = held.groupBy("list", "band").agg(
        F.count(F.lit(1)).alias("members"), F.max("open").alias("any_open"), F.max("own").alias("any_own")
    )
    return held.drop("own").join(lists.where("members > 1 and any_open and any_own").drop("any_own"), ["list", "band"])


def _block(percent: int):
    """Links (m, x) that connect what matches in one list of bounded length."""

    def run(table: pa.Table) -> pa.Table:
        nodes, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        e = table.column("e").to_numpy()
        column = table.column("differences").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        row = np.repeat(np.arange(len(nodes)), np.diff(column.offsets.to_numpy()))
        _, code, times = np.unique(column.flatten().to_numpy(), return_inverse=True, return_counts=True)
        held = times[code] > 1
        row, (kinds, code) = row[held], np.unique(code[held], return_inverse=True)
        common = np.zeros((len(nodes), len(nodes)), np.float32)
        for at in range(0, len(kinds), 2048):
            now = (code >= at) & (code < at + 2048)
            has = np.zeros((len(nodes), 2048), np.float32)
            has[row[now], code[now] - at] = 1
            common += has @ has.T
        apart = e[:, None] + e[None, :] - 2 * common.astype(np.int64)
        match = (100 - percent) * (n[:, None] + n[None, :]) >= (100 + percent) * apart
        np.fill_diagonal(match, True)
        root = np.arange(len(nodes))
        while True:
            new = np.where(match, root[None, :], len(nodes)).min(axis=1)
            if (new == root).all():
                break
            root = new
        moved = root != np.arange(len(nodes))
        return pa.table({"m": pa.array(nodes[root[moved]], pa.int64()), "x": pa.array(nodes[moved], pa.int64())})

    return run


def _short_pairs(short: DataFrame, percent: int) -> DataFrame:
    """(m, x): all pairs of fitting sizes of the short lists, of which one is open.

    Pairs of strong nodes must meet in SHARED lists, or in as many as the n-grams that a match needs. A pair counts
    once for a list, in the band of its larger set.
    """
    listed = short.groupBy("list", "band").agg(F.sort_array(F.collect_list(F.struct("n", "node", "open", "strong"))).alias("all"))
    placed = listed.select("band", "all", F.posexplode("all").alias("i", "a"))
    paired = placed.select("band", "a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b"))
    paired = paired.where(F.col("band") == _band(F.col("b.n"), percent))
    paired = paired.where((100 * F.col("a.n") >= percent * F.col("b.n")) & (F.col("a.open") | F.col("b.open")))
    pair = F.col("a.node").alias("m"), F.col("b.node").alias("x")
    need = F.least(F.lit(SHARED), F.ceil(percent * (F.col("a.n") + F.col("b.n")) / (100 + percent)).cast("int"))
    need = F.when(F.col("a.strong") & F.col("b.strong"), need).otherwise(1)
    met = paired.groupBy(*pair).agg(F.count(F.lit(1)).alias("met"), F.max(need).alias("need"))
    return met.where("met >= need").select("m", "x")


def _usual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per m: the sorted n-grams that most of its sets have."""
    for batch in batches:
        usual = []
        for sets in batch.column("sets"):
            values = np.concatenate([x.values.to_numpy().view(np.uint64) for x in sets])
            token, times = np.unique(values, return_counts=True)
            usual.append(token[2 * times > len(sets)])
        yield pa.RecordBatch.from_arrays([batch.column("m"), _lists(usual)], names=["m", "m_set"])
        give_back()


def _references(long: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((list, band, m), (m, m_set)): the reference of each long list, from REFERENCE_FROM of its members.

    Lists that came from the same list and have the same LEADERS first members, by hash, are taken together under
    one id ``m``: the lists of a group of near copies mostly do, so each of these is compared with few references.
    A difference from m is one that most of the members it was made from do not have, so the next lists are shorter.
    """
    order = W.partitionBy("list", "band").orderBy(F.xxhash64("node"), "node")
    some = long.withColumn("i", F.row_number().over(order)).where(F.col("i") <= REFERENCE_FROM)
    some = some.groupBy("list", "band", "parent").agg(F.sort_array(F.collect_list(F.struct("i", "node"))).alias("some"))
    nodes = F.transform("some", lambda x: x["node"])
    some = some.select("list", "band", "parent", nodes.alias("some"))
    of = written(some.withColumn("m", F.xxhash64("parent", F.slice("some", 1, LEADERS))), "of")
    each = of.select("m", F.explode("some").alias("node")).distinct()
    first = W.partitionBy("m").orderBy(F.xxhash64("node"), "node")
    members = each.withColumn("i", F.row_number().over(first)).where(F.col("i") <= REFERENCE_FROM).drop("i")
    held = members.join(sets, "node").groupBy("m").agg(F.collect_list("members").alias("sets"))
    return of.select("list", "band", "m"), held.mapInArrow(_usual, "m long, m_set array<long>")


def _scanned(compared: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links with c, entries of the next lists) from the members' differences from their references."""
    scale = 100 + percent
    w = (100 - percent) * F.col("n") - scale * F.col("e")
    best = compared.withColumn("w", w).groupBy("m").agg(F.max(F.struct("w", F.col("x").alias("c"))).alias("best"))
    found = compared.withColumn("w", w).join(best, "m").withColumn("open", F.col("w") + F.col("best.w") < 0)
    links = found.where("not open and x <> best.c").select(F.col("best.c").alias("m"), "x")
    need = F.when(F.col("open"), F.ceil(-(F.col("best.w") + F.col("w")) / (2 * scale))).otherwise(
        F.floor((F.col("best.w") - F.col("w")) / (2 * scale)) + 1
    )
    # k <= e(x) and 100|x| >= percent |y| give k >= e(y) - r(|x| + |y|) >= e(y) - r|y|(100 + percent) / percent
    need = F.greatest(need, F.ceil(F.col("e") - (100 - percent) * F.col("n") / percent))
    goes_on = found.groupBy("m").agg(F.max("open").alias("any_open")).where("any_open").select("m")
    keep = F.greatest(F.lit(0), F.col("e") - F.greatest(F.lit(1), need) + 1).cast("int")
    goes = found.join(goes_on, "m").select("m", "x", "n", "open", F.explode(F.slice("differences", 1, keep)).alias("d"))
    return links, goes.select(
        F.xxhash64("m", "d").alias("list"), F.col("x").alias("node"), "n", "open", F.lit(False).alias("strong"),
        F.col("m").alias("parent"),
    )


def _boundary(described: DataFrame, lengths: DataFrame, percent: int) -> int:
    """The set size from which scanning lists costs less than enumerating subsets."""
    small = described.where(F.col("n_shingles").between(1, LIGHT_SIZES))
    count = {r[0]: r[1] for r in small.groupBy("n_shingles").count().collect()}
    # an n-gram outside ``lengths`` is alone in its list
    scanned = (
        small.select("n_shingles", F.explode("first").alias("list"))
        .join(lengths, "list", "left")
        .groupBy("n_shingles")
        .agg(F.sum(F.coalesce("length", F.lit(1))))
        .collect()
    )
    scan = {r[0]: r[1] for r in scanned}
    totals = {
        x: sum(subset_count(s, percent) * count.get(s, 0) for s in range(1, x))
        + sum(scan.get(s, 0) for s in range(x, LIGHT_SIZES + 1))
        for x in range(1, LIGHT_SIZES + 2)
    }
    return min(totals, key=lambda x: (totals[x], x))


def similar_links(docs: DataFrame, size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(described, links): (doc_id, node, n_shingles) of every row, and links (a, b) of nodes.

    The links connect exactly the nodes that matching pairs connect; they need not hold each pair.
    """
    spark = docs.sparkSession
    texts, kind = docs.select("doc_id", "text"), docs.schema["doc_id"].dataType.simpleString()
    described = written(
        texts.mapInArrow(_describe(size, percent), f"doc_id {kind}, node long, n_shingles long, first array<long>"),
        "nodes",
    )
    lengths = written(
        described.select(F.explode("first").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("length")).where("length > 1"),
        "lengths",
    )
    total = described.agg(F.sum(F.size("first"))).first()[0] or 0
    frequent = lengths.where(F.col("length") >= max(FREQUENT_AT, total / FREQUENT_MOST)).select("list")
    # at most FREQUENT_MOST values, as the lists hold ``total`` entries together
    late = np.sort(np.array([r[0] for r in frequent.collect()], np.int64).view(np.uint64))
    late = spark.sparkContext.broadcast(late)
    boundary = _boundary(described, lengths, percent)

    entries = texts.mapInArrow(_entries(size, percent, boundary, late), "list long, node long, n long, strong boolean, many boolean")
    # a frequent list has members enough; of the others those with two different nodes go on
    one = W.partitionBy("list")
    rare = entries.where("not many").select("list", "node", "n", "strong")
    rare = rare.withColumns({"low": F.min("node").over(one), "high": F.max("node").over(one)}).where("low < high")
    entries = rare.drop("low", "high").union(entries.where("many").select("list", "node", "n", "strong")).distinct()
    entries = written(entries, "entries").withColumns({"open": F.lit(True), "parent": F.lit(0).cast("long")})
    sets = None
    links = empty_like(spark, "m long, x long")
    first = described.where("node is not null").select("node", "n_shingles", "first")
    compared = None
    while not entries.isEmpty():
        live = written(_live_members(entries, percent), "live")
        length = F.col("members")
        pairs = written(_short_pairs(live.where(length <= SHORT_LIST), percent), "short")
        asked = spark.sparkContext.broadcast(_bitmap(pairs.select(F.col("m").alias("node")).union(pairs.select("x"))))
        known = first.mapInArrow(_among(asked), "node long, n_shingles long, first array<long>").dropDuplicates(["node"])
        x_first, m_first = (
            known.select(F.col("node").alias(k), F.col("n_shingles").alias(f"{k}_n"), F.col("first").alias(f"{k}_set")) for k in "xm"
        )
        pairs = pairs.join(x_first, "x").join(m_first, "m")
        pairs = written(pairs.mapInArrow(_possible(percent), "m long, x long"), "pairs")
        long = live.where(length > (SHORT_LIST if compared is None else BLOCK))
        long = long.select("list", "band", "node", "n", "parent")
        if sets is None:
            nodes = pairs.select(F.col("m").alias("node")).union(pairs.select("x")).union(long.select("node")).distinct()
            wanted = spark.sparkContext.broadcast(_bitmap(nodes))
            found = texts.mapInArrow(_members(size, wanted), "node long, members array<long>")
            sets = written(found.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "sets")
            x_sets = sets.select(F.col("node").alias("x"), F.col("members").alias("x_set"))
            m_sets = sets.select(F.col("node").alias("m"), F.col("members").alias("m_set"))
        linked = pairs.join(x_sets, "x").join(m_sets, "m").mapInArrow(_match(percent), "m long, x long")
        links = links.union(written(linked, "matched"))
        if compared is not None:
            blocks = live.where((length > SHORT_LIST) & (length <= BLOCK)).select("list", "band", "node", "n", "parent")
            blocks = blocks.join(
                compared.select(F.col("m").alias("parent"), F.col("x").alias("node"), "e", "differences"), ["parent", "node"]
            )
            links = links.union(written(blocks.groupBy("list", "band").applyInArrow(_block(percent), "m long, x long"), "blocks"))
        if long.isEmpty():
            break
        of, references = _references(long, sets)
        compared = written(
            long.join(of, ["list", "band"])
            .select("m", F.col("node").alias("x"), "n")
            .distinct()
            .join(x_sets, "x")
            .join(references, "m")
            .select("m", "x", "n", "x_set", "m_set")
            .mapInArrow(_differences(late), "m long, x long, n long, e long, differences array<long>"),
            "compared",
        )
        near, entries = _scanned(compared, percent)
        links = links.union(near)
        entries = written(entries, "lists")
    return described.drop("first"), links.select(F.col("m").alias("a"), F.col("x").alias("b"))


def near_duplicate_classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id reached by links. Rows without words (null, empty, blank)
    are linked with nothing and keep their own doc_id. Repeated rows and equal texts share a class; a
    null doc_id is never the smallest, so a class has it only if it has no other. Other columns are
    ignored.
    """
    described, links = similar_links(docs, size, percent)
    roots = components(links)
    ids = described.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    ids = ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = ids.join(least, "root").select("node", "component_id")
    found = described.join(classes, "node", "left")
    return found.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
