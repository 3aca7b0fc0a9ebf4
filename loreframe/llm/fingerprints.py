"""Document fingerprints by SimHash, and all fingerprints within a Hamming radius.

A term is a shingle of five words (the whole sequence of a shorter text), weighted by the bit length of
its count. Each bit of a term's hash votes with its weight, up if set and down if not; a bit of the
fingerprint is set where the votes are not negative.

Two fingerprints within the radius differ in at most as many bits, so of ``radius + extra`` blocks at
least ``extra`` agree. There is one permuted table for each choice of that many blocks; fingerprints that
agree in a table's blocks are candidates and are checked. That is exact, and fit for few bits.

Near copies of ordinary texts are farther apart: at a Jaccard similarity of 0.9 some 27 of 256 bits. For
them ``near_classes`` takes the radius from the similarity. As many permutations of the bits, cut into blocks
of one width each, as the wanted recall needs link most near copies into classes. Pairs of different classes are
then searched without loss: the bits are cut into blocks of which one at least is nearly equal in every pair within
the radius, and all keys that near an own one are looked up in a table of each block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loreframe.llm.tables import components
from loreframe.llm.wordarrays import mix, shingles, slices, text_bytes, word_hashes
from loreframe.session import written

BITS = 256
WORDS = 5
_SALTS = mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fingerprints(column: pa.Array) -> list[bytes]:
    """Fingerprint of every text of a column; null and blank texts get all bits set."""
    words, offsets = word_hashes(*text_bytes(column))
    terms, at = shingles(words, offsets, WORDS)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        votes, total = np.zeros(BITS), 0.0
        own = terms[a:b]
        own, counts = np.unique(own, return_counts=True)
        weights = np.frexp(counts)[1].astype(np.float32)
        for k in range(0, len(own), 4096):
            bits = np.unpackbits(mix(own[k : k + 4096, None] + _SALTS[None, :]).view(np.uint8), axis=1)
            votes += weights[k : k + 4096] @ bits.astype(np.float32)
            total += float(weights[k : k + 4096].sum())
        out.append(np.packbits(2 * votes >= total).tobytes())
    return out


def edited_text(text: str, following: str) -> str:
    """The text with its second half replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _likeness(a: bytes, b: bytes) -> float:
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def _in_order(kind: pa.DataType):
    """Rows come by bucket and order, with the first row of the next bucket at the end of each."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = pa.array([t or "" for t in batch.column("text").to_pylist()], pa.large_string())
                yield from zip(
                    batch.column("bucket").to_pylist(),
                    batch.column("is_next").to_pylist(),
                    batch.column("doc_id").to_pylist(),
                    texts.to_pylist(),
                    fingerprints(texts),
                )

    def emit(found: list[tuple]) -> pa.RecordBatch:
        edits = [e for *_, e, _, _ in found]
        marks = fingerprints(pa.array(edits, pa.large_string()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, *_ in found], kind),
                pa.array([n for _, n, *_ in found], pa.int64()),
                pa.array([sha256(e.encode()).hexdigest() for e in edits]),
                pa.array([f.hex() for *_, f, _ in found]),
                pa.array([m.hex() for m in marks]),
                pa.array([_likeness(f, m) for (*_, f, _), m in zip(found, marks)], pa.float64()),
                pa.array([_likeness(f, g) for *_, f, g in found], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, found, room = None, [], 1 << 22
        for bucket, is_next, doc_id, text, mark in rows(batches):
            if before is not None and before[0] == bucket:
                _, old_id, old_text, old_mark = before
                edit = edited_text(old_text, text)
                found.append((old_id, len(old_text), edit, old_mark, mark))
                room -= len(edit)
                if room < 0:
                    yield emit(found)
                    found, room = [], 1 << 22
            before = None if is_next else (bucket, doc_id, text, mark)
        if found:
            yield emit(found)

    return run


def fingerprint_edits(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of ``docs(doc_id, text)``, of its edited texts and their likeness.

    The following document is the next by doc_id, after the last the first; null ids come first, and rows
    of one doc_id are ordered by their texts' hash. A single row follows itself. Null texts count as empty.
    Texts move once: into ranges of doc_id, cut at quantiles of all ids; the first row of each range is sent
    to the one before as well. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    count = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select("doc_id").where("doc_id is not null")
    steps = [k / count for k in range(1, count)]
    # one number for each range; any cuts give the same result
    cuts = sorted(set(ids.approxQuantile("doc_id", steps, 0.25 / count))) if steps else []
    edges = F.array(*[F.lit(int(c)) for c in cuts]).cast("array<bigint>")
    bucket = F.coalesce(F.size(F.filter(edges, lambda e: e < F.col("doc_id"))), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "text").withColumn("bucket", bucket).withColumn("tie", F.xxhash64("text"))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"), F.col("tie"))
    heads = rows.groupBy("bucket").agg(F.min(order).alias("head")).collect()  # one row for each range
    heads = sorted((r["bucket"], r["head"]["doc_id"], r["head"]["tie"]) for r in heads)
    if not heads:
        return spark.createDataFrame([], _schema(kind))
    before = [heads[i - 1][0] for i in range(len(heads))]
    sent = spark.createDataFrame(
        [(b, d, t, to) for (b, d, t), to in zip(heads, before)],
        f"bucket long, head_id {kind.simpleString()}, head_tie long, to_bucket long",
    )
    marked = rows.join(F.broadcast(sent), "bucket")
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & F.col("tie").eqNullSafe(F.col("head_tie"))
    own = F.struct(F.col("bucket"), F.lit(False).alias("is_next"))
    onward = F.struct(F.col("to_bucket").alias("bucket"), F.lit(True).alias("is_next"))
    places = marked.withColumn("place", F.explode(F.when(is_head, F.array(own, onward)).otherwise(F.array(own))))
    placed = places.select("place.bucket", "place.is_next", "doc_id", "tie", "text")
    ordered = placed.repartition(count, "bucket").sortWithinPartitions(
        "bucket", "is_next", F.col("doc_id").asc_nulls_first(), "tie"
    )
    return ordered.select("bucket", "is_next", "doc_id", "text").mapInArrow(_in_order(pa_type(kind)), _schema(kind))


def pa_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _schema(kind) -> str:
    return (
        f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double"
    )


def _distance(a: str, b: str) -> Column:
    """Bits in which two fingerprints (hex strings) differ."""

    def part(name: str, k: int) -> Column:
        return F.conv(F.substring(name, k, 8), 16, 10).cast("long")

    return sum(F.bit_count(part(a, k).bitwiseXOR(part(b, k))) for k in range(1, BITS // 4, 8)).cast("int")


def within_radius(marks: DataFrame, radius: int = 3, extra: int = 2) -> DataFrame:
    """(a, b, distance) of distinct fingerprints (hex strings) of ``marks(fingerprint)`` within the radius.

    A fingerprint stands for all rows that have it; nulls are left out. ``extra`` blocks more than the
    radius make longer keys and more tables: with 256 bits, radius 3 and 2 more, 10 tables of 102 bits.
    """
    blocks = radius + extra
    digits = BITS // 4
    edges = [round(k * digits / blocks) for k in range(blocks + 1)]
    one = marks.where("fingerprint is not null").select("fingerprint").distinct()

    def key(choice: tuple[int, ...]) -> Column:
        parts = [F.substring("fingerprint", edges[k] + 1, edges[k + 1] - edges[k]) for k in choice]
        return F.concat(F.lit(",".join(map(str, choice)) + ":"), *parts)

    tables = one.select("fingerprint", F.explode(F.array(*[key(c) for c in combinations(range(blocks), extra)])).alias("key"))
    shared = tables.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    found = tables.join(shared, "key")
    a, b = found.select("key", F.col("fingerprint").alias("a")), found.select("key", F.col("fingerprint").alias("b"))
    pairs = a.join(b, "key").where("a < b").select("a", "b").distinct()
    return pairs.withColumn("distance", _distance("a", "b")).where(F.col("distance") <= radius)


def radius_for(similarity: float) -> int:
    """Bits that pairs of this Jaccard similarity differ in, and two standard deviations more."""
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(BITS * apart + 2 * math.sqrt(BITS * apart * (1 - apart)))


def expected_recall(similarity: float, radius: int, width: int, tables: int) -> float:
    """Share of the pairs of this similarity that are within the radius and agree in a table."""
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    found = 0.0
    for d in range(radius + 1):
        chance = math.comb(BITS, d) * apart**d * (1 - apart) ** (BITS - d)
        agree = math.comb(BITS - d, width) / math.comb(BITS, width)
        found += chance * (1 - (1 - agree) ** tables)
    return found


def tables_for(similarity: float, radius: int, width: int, recall: float) -> int:
    """The fewest tables of that key width with the recall; raises where the radius rules it out."""
    if expected_recall(similarity, radius, width, 1 << 20) < recall:
        raise ValueError("no number of tables reaches this recall")
    low, high = 1, 1 << 20
    while low < high:
        half = (low + high) // 2
        low, high = (low, half) if expected_recall(similarity, radius, width, half) >= recall else (half + 1, high)
    return low


FULL_BUCKET = 1 << 16  # entries of a table's bucket compared in one task; larger ones are split first
SAMPLED = 64  # one entry of so many tells which buckets are large; it steers cost only


def _entries(width: int, tables: int):
    """(node, fingerprint) to one (key, node, part) for each table; the part is 64 bits to compare."""
    rng, blocks = np.random.default_rng(0), BITS // width
    order = np.concatenate([rng.permutation(BITS)[: blocks * width] for _ in range(-(-tables // blocks))])
    places = order.reshape(-1, width)[:tables]
    powers = np.int64(1) << np.arange(width, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                raw = bytes.fromhex("".join(batch.column("fingerprint").to_pylist()))
                marks = np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8)
                bits = np.unpackbits(marks, axis=1).astype(np.int64)
                part = marks[:, :8].copy().view(np.int64).ravel()
                node = batch.column("node").to_numpy()
                for table in range(tables):
                    key = bits[:, places[table]] @ powers * tables + table
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(part)], names=["key", "node", "part"])

    return run


def _bucket_links(limit: int):
    """Links of every bucket, whose rows come together, to leaders; leaders of split buckets with their key.

    The first row that no leader is like becomes a leader and is compared with all rows of the bucket, those
    linked before included, until every row is a leader or like one.
    """

    def of_bucket(nodes: np.ndarray, parts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[int]]:
        free, a, b, leaders = np.ones(len(nodes), bool), [], [], []
        while free.any():
            lead = int(free.argmax())
            like = np.bitwise_count(parts ^ parts[lead]) <= limit
            free &= ~like
            like[lead] = False
            a.append(nodes[like])
            b.append(np.full(len(a[-1]), nodes[lead]))
            leaders.append(lead)
        return a, b, leaders

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "salt", "node", "part"]
        open_rows = [np.zeros(0, np.int64)] * 4

        def settle(rows: list[np.ndarray], edges: np.ndarray) -> pa.RecordBatch:
            links: list[list] = [[], [], [], []]
            for x, y in zip(edges[:-1], edges[1:]):
                split = rows[1][x] >= 0
                if y - x < 2 and not split:
                    continue
                parts = rows[3][x:y].view(np.uint64)
                a, b, leaders = of_bucket(rows[2][x:y], parts)
                for k, values in enumerate((a, b)):
                    links[k].extend(values)
                count = sum(map(len, a))
                links[2].append(np.full(count, -1))
                links[3].append(np.zeros(count, np.int64))
                if split:
                    chosen = x + np.array(leaders)
                    for k, values in enumerate((rows[2][chosen], np.full(len(chosen), -1), rows[0][chosen], rows[3][chosen])):
                        links[k].append(values)
            arrays = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in links]
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in arrays], names=["a", "b", "key", "part"])

        for batch in batches:
            rows = [np.concatenate([o, batch.column(n).to_numpy()]) for o, n in zip(open_rows, names)]
            if not len(rows[0]):
                continue
            new = (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)
            edges = np.concatenate([[0], np.flatnonzero(new) + 1])
            yield settle(rows, edges)
            open_rows = [r[edges[-1] :] for r in rows]  # the last bucket may go on
        yield settle(open_rows, np.array([0, len(open_rows[0])]) if len(open_rows[0]) else np.zeros(0, int))

    return run


BLOCKS = 13  # blocks of the bits in the search without loss
KEY_BITS = 20  # bits of a block that are looked up
CELL = 1 << 21  # fingerprints on one side of a cell, about, at most
SMALL_CELL = 1 << 12  # below so many on one side there are fewer cells
STEP = 1 << 20  # candidate pairs that are checked at once
WIDE = 16  # in places with more entries than this those of the asking row's class are skipped by search


def _nearly_equal(radius: int) -> list[tuple[int, int, int]]:
    """(first bit, bits looked up, differing bits) of blocks; pairs within the radius differ by no more in one at least."""
    count = min(BLOCKS, radius + 1)
    edges = [round(k * BITS / count) for k in range(count + 1)]
    least, more = divmod(radius + 1, count)  # one bit more in every block would be radius + 1 in all
    return [(a, min(b - a, KEY_BITS), least - 1 + (k < more)) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]


def _block_key(words: np.ndarray, first: int, width: int) -> np.ndarray:
    """The bits from ``first`` on of fingerprints, given as rows of 64-bit words."""
    word, skipped = divmod(first, 64)
    value = words[word] << np.uint64(skipped)
    if skipped + width > 64:
        value = value | (words[word + 1] >> np.uint64(64 - skipped))
    return (value >> np.uint64(64 - width)).astype(np.int64)


def _ranges(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(range, place) of every place of the ranges, about ``STEP`` at a time."""
    count = high - low
    ends = np.cumsum(count)
    cuts = np.searchsorted(ends, np.arange(STEP, ends[-1] if len(ends) else 0, STEP)) + 1
    cuts = np.unique(np.concatenate([[0], cuts, [len(count)]]))
    for x, y in zip(cuts[:-1], cuts[1:]):
        own = count[x:y]
        before = np.cumsum(own) - own
        yield np.repeat(np.arange(x, y), own), np.arange(own.sum()) + np.repeat(low[x:y] - before, own)


def _cell_links(radius: int, parts: int):
    """Classes that a pair within the radius links, from the fingerprints of two parts (or of one)."""

    def run(table: pa.Table) -> pa.Table:
        i, j = divmod(table.column("cell")[0].as_py(), parts)
        part = table.column("part").to_numpy()
        words = np.stack([table.column(f"w{k}").to_numpy() for k in range(BITS // 64)]).view(np.uint64)
        names, root = np.unique(table.column("root").to_numpy(), return_inverse=True)
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        found = [np.zeros(0, np.int64)]
        for first, width, differing in _nearly_equal(radius):
            key = _block_key(words, first, width)
            starts = np.concatenate([[0], np.cumsum(np.bincount(key[right], minlength=1 << width))])
            coded = key[right] * len(names) + root[right]
            order = np.argsort(coded)
            coded, at = coded[order], right[order]
            own = key[left]
            for flips in (c for n in range(differing + 1) for c in combinations(range(width), n)):
                asked = own ^ sum(1 << k for k in flips)
                low, high = starts[asked], starts[asked + 1]
                hit = np.flatnonzero(low < high)
                who, asked, low, high = left[hit], asked[hit], low[hit], high[hit]
                wide = high - low > WIDE
                if wide.any():  # entries of one class stand together
                    same = asked[wide] * len(names) + root[who[wide]]
                    a, b = np.searchsorted(coded, same, "left"), np.searchsorted(coded, same, "right")
                    low, high = np.concatenate([low[~wide], low[wide], b]), np.concatenate([high[~wide], a, high[wide]])
                    who = np.concatenate([who[~wide], who[wide], who[wide]])
                for row, place in _ranges(low, high):
                    a, b = who[row], at[place]
                    half = sum(np.bitwise_count(words[k][a] ^ words[k][b]) for k in range(2))
                    near = np.flatnonzero((half <= radius) & (root[a] != root[b]))
                    a, b = a[near], b[near]
                    apart = np.bitwise_count(words[:, a] ^ words[:, b]).sum(axis=0, dtype=np.int64)
                    a, b = root[a[apart <= radius]], root[b[apart <= radius]]
                    if len(a):
                        found.append(np.unique(np.minimum(a, b) * len(names) + np.maximum(a, b)))
            found = [np.unique(np.concatenate(found))]
        a, b = np.divmod(found[0], max(1, len(names)))
        return pa.table({"a": pa.array(names[a], pa.int64()), "b": pa.array(names[b], pa.int64())})

    return run


def _links_between(known: DataFrame, total: int, radius: int) -> DataFrame:
    """(a, b) of all classes that a pair within the radius links, from ``known(fingerprint, root)``.

    The fingerprints are dealt into parts by hash, and every two parts meet in one cell, the unit of work: it holds a
    bounded number of fingerprints, and the parts, not the pairs, are copied.
    """
    parts = min(8, -(-total // SMALL_CELL)) if total <= 8 * CELL else -(-total // CELL)
    parts = max(1, parts)
    words = [F.conv(F.substring("fingerprint", 16 * k + 1, 16), 16, -10).cast("long").alias(f"w{k}") for k in range(BITS // 64)]
    part = F.pmod(F.xxhash64("fingerprint"), F.lit(parts)).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(parts - 1)), lambda c: F.least("part", c) * parts + F.greatest("part", c)
    )
    dealt = known.select("root", part.alias("part"), *words).withColumn("cell", F.explode(cells))
    spread = dealt.repartition(parts * parts + parts, "cell")  # twice as many as cells
    return spread.groupBy("cell").applyInArrow(_cell_links(radius, parts), "a long, b long").distinct()


def near_classes(marks: DataFrame, similarity: float = 0.9, recall: float = 0.9, width: int | None = None) -> DataFrame:
    """Classes of ``marks(doc_id, fingerprint)``: fingerprint, near_class and n_near.

    Fingerprints link when they differ in at most ``radius_for(similarity)`` bits; near_class is the smallest
    doc_id reachable by links, n_near the number of other rows in the class, copies included. Rows of one
    fingerprint are one node; null fingerprints are left out; null doc_ids count and never name a class,
    unless it has no other.

    Tables have keys of ``width`` bits, as many as tell all fingerprints apart and at least 24, and are so many
    that pairs of the similarity are found with the recall. Found links are checked on all bits, so none is
    wrong. Within a bucket rows link to leaders, not to each other. Buckets above ``FULL_BUCKET`` are first
    split by a hash, then their leaders compared. All that is left out so far are pairs of different classes,
    and of these ``_links_between`` finds every one within the radius. So the classes are those of all pairs;
    ``recall`` and ``width`` steer cost only.
    """
    one = marks.where("fingerprint is not null").groupBy("fingerprint")
    one = one.agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = written(one.withColumn("node", F.monotonically_increasing_id()), "fingerprint_nodes")
    total = nodes.count()
    width = width or max(24, total.bit_length())
    radius = radius_for(similarity)
    tables = tables_for(similarity, radius, width, recall)
    share = radius / BITS
    limit = int(64 * share + 4 * math.sqrt(64 * share * (1 - share)))
    entries = nodes.select("node", "fingerprint").mapInArrow(_entries(width, tables), "key long, node long, part long")
    sampled = nodes.where(F.pmod(F.xxhash64("fingerprint"), F.lit(SAMPLED)) == 0).select("node", "fingerprint")
    counted = sampled.mapInArrow(_entries(width, tables), "key long, node long, part long").groupBy("key").count()
    full_bucket = max(FULL_BUCKET, total * tables >> 20)  # so some million keys at most can be large, 16 bytes each
    large = counted.where(F.col("count") * SAMPLED > full_bucket).select(
        "key", F.ceil(F.col("count") * SAMPLED / full_bucket).alias("pieces")
    )
    salt = F.when(F.col("pieces") > 0, F.pmod(F.xxhash64("node"), F.col("pieces"))).otherwise(F.lit(-1)).cast("long")
    salted = entries.join(F.broadcast(large), "key", "left").select("key", salt.alias("salt"), "node", "part")
    links = "a long, b long, key long, part long"
    first = salted.repartition("key", "salt").sortWithinPartitions("key", "salt")
    found = written(first.mapInArrow(_bucket_links(limit), links), "fingerprint_links")
    leaders = found.where("key >= 0").select("key", F.lit(-1).cast("long").alias("salt"), F.col("a").alias("node"), "part")
    again = leaders.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links(limit), links)
    pairs = found.where("key < 0").select("a", "b").union(again.select("a", "b"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    full = nodes.select("node", "fingerprint")
    sides = pairs.join(full.toDF("a", "x"), "a").join(full.toDF("b", "y"), "b")
    roots = components(sides.where(_distance("x", "y") <= radius).select("a", "b"))
    known = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    joined = components(_links_between(known.select("fingerprint", "root"), total, radius)).toDF("root", "joined")
    known = known.join(joined, "root", "left").withColumn("root", F.coalesce("joined", "root"))
    classes = known.groupBy("root").agg(F.min("least").alias("near_class"), F.sum("copies").alias("all"))
    return known.join(classes, "root").select("fingerprint", "near_class", (F.col("all") - 1).alias("n_near"))
