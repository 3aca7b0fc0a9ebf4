"""Blocks to chunks. Blocks are rows (file_id, pos, text, block_type, page_number, section_title).

Every step works per file: windows and groups are keyed by the file, whose size is one document.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from loreframe.functions import text as tx
from loreframe.functions.constants import CHUNKER_TYPES, SKIP_SECTION_PATTERN, UNSECTIONED

POSITION_TAG = r"@@[0-9-]+\t[0-9.\t]+##"
TAG_PARTS = r"@@([0-9-]+)\t([0-9.]+)\t([0-9.]+)\t([0-9.]+)\t([0-9.]+)##"


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, POSITION_TAG, "")


def pdf_positions(tag: Column) -> Column:
    """[page, left, right, top, bottom] per position tag, each side in order."""
    def part(t, n):
        return F.regexp_extract(t, TAG_PARTS, n)

    found = F.regexp_extract_all(tag, F.lit(TAG_PARTS), 0)
    return F.transform(
        found,
        lambda t: F.array(
            F.greatest(F.element_at(F.split(F.regexp_replace(part(t, 1), "-+$", ""), "-"), -1).cast("double"), F.lit(1.0)),
            F.least(part(t, 2).cast("double"), part(t, 3).cast("double")),
            F.greatest(part(t, 2).cast("double"), part(t, 3).cast("double")),
            F.least(part(t, 4).cast("double"), part(t, 5).cast("double")),
            F.greatest(part(t, 4).cast("double"), part(t, 5).cast("double")),
        ),
    )


def section_path(title: Column) -> Column:
    return tx.clean_items(F.split(F.coalesce(title, F.lit("")), ">"))


def combined_type(types: Column) -> Column:
    return (
        F.when(F.size(types) == 0, "text").when(F.size(types) == 1, F.get(types, F.lit(0))).otherwise("mixed")
    )


def chunk_rows(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """Chunk metadata of grouped blocks: text, pages, last section, type, size."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "text")))
    last = F.max_by(F.nullif("section_title", F.lit("")), F.when(F.coalesce("section_title", F.lit("")) != "", F.col("pos")))
    return grouped.groupBy(*keys).agg(
        tx.strip(strip_tags(F.array_join(F.filter(F.transform(rows, lambda r: r["text"]), lambda x: x != ""), "\n"))).alias("text"),
        F.min("page_number").alias("page_start"),
        F.max("page_number").alias("page_end"),
        F.array_join(section_path(last), " > ").alias("section"),
        combined_type(F.collect_set(F.nullif("block_type", F.lit("")))).alias("block_type"),
        F.count(F.lit(1)).alias("block_count"),
    )


def naive_groups(
    blocks: DataFrame, tokens: Column | None = None, chunk_tokens: int = 512, overlap_percent: int = 0
) -> DataFrame:
    """Adds ``chunk_no``: a new chunk starts once the running total has passed the threshold.

    The test looks at the total before adding, and every block counts its leading line break. Blocks
    without a text take part only if they have an asset (column ``asset_paths``, where there is one).
    """
    threshold = max(chunk_tokens, 0) * (100 - min(max(overlap_percent, 0), 99)) / 100
    size = (tokens if tokens is not None else F.length(F.concat(F.lit("\n"), "text"))).cast("long")
    has_content = ~tx.blank(F.col("text"))
    if "asset_paths" in blocks.columns:
        has_content = has_content | (F.coalesce(F.size(F.map_keys("asset_paths")), F.lit(0)) > 0)
    kept = blocks.withColumn("text", F.coalesce("text", F.lit(""))).filter(has_content)

    names = kept.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, chunk, total = object(), 0, 0
        for batch in batches:
            numbers = []
            for own, n in zip(batch.column("file_id").to_pylist(), batch.column("__size").to_pylist()):
                if own != file:
                    file, chunk, total = own, 0, 0
                elif total > threshold:
                    chunk, total = chunk + 1, 0
                total += n
                numbers.append(chunk)
            rest = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(numbers, pa.int64())], names=[*names, "chunk_no"])

    # one exchange with the texts; a file's blocks follow one another, many files share a batch
    ordered = kept.withColumn("__size", size).repartition("file_id").sortWithinPartitions("file_id", "pos")
    return ordered.mapInArrow(number, T.StructType(kept.schema.fields + [T.StructField("chunk_no", T.LongType())]))


def naive_chunks(blocks: DataFrame, chunk_tokens: int = 512, overlap_percent: int = 0) -> DataFrame:
    """Merged chunks; with an overlap each chunk begins with the tail of the finished one before."""
    grouped = naive_groups(blocks, chunk_tokens=chunk_tokens, overlap_percent=overlap_percent)
    chunks = chunk_rows(grouped, ["file_id", "chunk_no"])
    overlap = min(max(overlap_percent, 0), 99)
    if not overlap:
        return chunks

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_no")
        texts, before = [], ""
        for body in pdf["text"]:
            tail = before[int(len(before) * (100 - overlap) / 100):] if before else ""
            before = (tail + "\n" + body).strip()
            texts.append(before)
        return pdf.assign(text=texts)

    return chunks.groupBy("file_id").applyInPandas(carry, chunks.schema)


def source_offsets(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position_tags, pdf_positions) of the chunks with a position tag, to trace them to their pages.

    ``grouped`` is blocks with a chunk number and ``position_tag``. Tags are listed in the order of the blocks, repeats
    included; positions [page, left, right, top, bottom] once each, where they come first.
    """
    tagged = grouped.where(~tx.blank(F.col("position_tag"))).select(*keys, "pos", "position_tag")
    listed = F.sort_array(F.collect_list(F.struct("pos", "position_tag")))
    tags = tagged.groupBy(*keys).agg(F.transform(listed, lambda x: x["position_tag"]).alias("position_tags"))
    each = tagged.select(*keys, "pos", F.posexplode(pdf_positions(F.col("position_tag"))).alias("nth", "position"))
    first = each.groupBy(*keys, "position").agg(F.min(F.struct("pos", "nth")).alias("first"))
    distinct = F.sort_array(F.collect_list(F.struct("first", "position")))
    positions = first.groupBy(*keys).agg(F.transform(distinct, lambda x: x["position"]).alias("pdf_positions"))
    return tags.join(positions, keys, "left")


def delimiter_chunks(blocks: DataFrame, delimiters: list[str]) -> DataFrame:
    """Every piece between custom delimiters is a chunk of its own."""
    pattern = "|".join(re.escape(d) for d in sorted(set(delimiters), key=lambda d: (-len(d), d)))
    pieces = tx.clean_items(F.split("text", pattern))
    return blocks.select("file_id", "pos", F.posexplode(pieces).alias("piece_no", "text")).withColumn(
        "piece_no", F.col("piece_no").cast("long")
    )


def manual_groups(blocks: DataFrame) -> DataFrame:
    """Adds ``chunk_no`` and ``key``: runs of blocks under one section."""
    title = F.nullif(tx.strip(F.coalesce("section_title", F.lit(""))), F.lit(""))
    own = F.when(F.lower("block_type") == "title", F.nullif(tx.strip("text"), F.lit("")))
    keyed = blocks.withColumn("key", F.coalesce(title, own, F.lit(UNSECTIONED)))
    order = W.partitionBy("file_id").orderBy("pos")
    changed = F.when(F.lag("key").over(order) == F.col("key"), 0).otherwise(1)
    return keyed.withColumn("__new", changed).withColumn(
        "chunk_no", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - 1
    ).drop("__new")


def manual_chunks(blocks: DataFrame) -> DataFrame:
    chunks = chunk_rows(manual_groups(blocks), ["file_id", "chunk_no", "key"])
    return chunks.filter("text <> ''").withColumn(
        "section", F.array_join(section_path(F.col("key")), " > ")
    ).drop("key")


@F.pandas_udf(T.ArrayType(T.StringType()))
def csv_fields(line: pd.Series) -> pd.Series:
    """Fields of one comma row (quotes respected)."""
    def fields(x):
        if not x:
            return []
        try:
            return [p.strip() for p in next(csv.reader([x]))]
        except (csv.Error, StopIteration):
            return [x]

    return line.map(fields)


def qa_pair(text: Column) -> Column:
    """(question, answer) of a two-column row: tab separated, else comma separated."""
    t = tx.strip(text)
    tabbed = F.transform(F.split(t, "\t"), tx.strip)
    good_tab = F.contains(t, F.lit("\t")) & (F.size(tabbed) == 2) & ~F.array_contains(tabbed, "")
    fields = csv_fields(t)
    good_csv = (F.size(fields) == 2) & ~F.array_contains(fields, "")
    pair = F.when(good_tab, tabbed).when(good_csv, fields)
    return F.when(
        pair.isNotNull(),
        F.struct(F.get(pair, F.lit(0)).alias("question"), F.get(pair, F.lit(1)).alias("answer")),
    )


def qa_chunks(blocks: DataFrame) -> DataFrame:
    """Question-answer chunks; other rows extend the answer before them, leading ones are dropped."""
    order = W.partitionBy("file_id").orderBy("pos")
    paired = blocks.withColumn("pair", qa_pair(F.col("text"))).withColumn(
        "chunk_no",
        F.sum(F.when(F.col("pair").isNotNull(), 1).otherwise(0)).over(
            order.rowsBetween(W.unboundedPreceding, W.currentRow)
        ) - 1,
    )
    line = F.coalesce("pair.answer", tx.strip("text"))
    rows = F.sort_array(F.collect_list(F.struct("pos", line.alias("line"))))
    answer = F.array_join(F.filter(F.transform(rows, lambda r: r["line"]), lambda x: x != ""), "\n")
    return (
        paired.filter("chunk_no >= 0")
        .groupBy("file_id", "chunk_no")
        .agg(
            F.min_by("pair.question", "pos").alias("question"),
            answer.alias("answer"),
            F.min("page_number").alias("page_start"),
            F.max("page_number").alias("page_end"),
            F.count(F.lit(1)).alias("block_count"),
        )
        .withColumn(
            "text", F.concat(F.lit("问题："), "question", F.lit("\n回答："), "answer")
        )
    )


def split_table_row(line: Column) -> Column:
    t = F.regexp_replace(tx.strip(line), r"^\|+|\|+$", "")
    return (
        F.when(F.contains(t, F.lit("|")), F.transform(F.split(t, r"\|"), tx.strip))
        .when(F.contains(t, F.lit("\t")), F.transform(F.split(t, "\t"), tx.strip))
    )


def table_chunks(blocks: DataFrame) -> DataFrame:
    """One chunk per data row as ``- header: value`` lines; the first row names the columns.

    Rows are pipe or tab separated; rows without either separator are read as comma rows.
    """
    lines = tx.clean_items(F.split("text", r"\r\n|[\n\r]"))
    tables = blocks.filter(F.lower("block_type").isin("table", "table_row")).select(
        "file_id", "pos", "page_number", "section_title", F.posexplode(lines).alias("row_no", "line")
    )
    rows = tables.withColumn(
        "cells",
        F.coalesce(split_table_row(F.col("line")), csv_fields(F.regexp_replace(tx.strip("line"), r"^\|+|\|+$", ""))),
    )
    header = rows.filter("row_no = 0").select("file_id", "pos", F.col("cells").alias("headers"))
    named = rows.filter("row_no > 0").join(header, ["file_id", "pos"])
    distinct = F.size(F.array_distinct(F.filter("headers", lambda h: h != ""))) == F.size(
        F.filter("headers", lambda h: h != "")
    )
    pairs = F.filter(
        F.arrays_zip(F.col("headers").alias("h"), F.col("cells").alias("c")), lambda p: p["c"] != ""
    )
    text = F.array_join(
        F.transform(pairs, lambda p: F.concat(F.lit("- "), p["h"], F.lit(": "), p["c"])), "\n"
    )
    return (
        named.filter((F.size("headers") > 0) & (F.size("cells") == F.size("headers")))
        .filter(distinct)
        .select(
            "file_id", "pos", F.col("row_no").cast("long").alias("row_index"), text.alias("text"),
            "page_number", "section_title",
        )
        .filter("text <> ''")
    )


def chunk_pipeline(blocks: DataFrame, chunkers: DataFrame) -> DataFrame:
    """Every file's blocks through its own chunker; an unknown chunker is reported, not guessed."""
    kind = F.coalesce(F.nullif(F.lower(tx.strip("chunker_type")), F.lit("")), F.lit("naive"))
    routed = blocks.join(chunkers.select("file_id", kind.alias("chunker")), "file_id")

    def only(name):
        return routed.filter(F.col("chunker") == name).drop("chunker")

    def shape(df, name, number, chunk_type, row=None):
        row = F.lit(0) if row is None else row
        return df.select(
            "file_id", F.lit(name).alias("chunker"), number.cast("long").alias("chunk_no"), row.cast("long").alias("row_no"),
            "text", chunk_type.alias("block_type"),
        )

    naive = shape(naive_chunks(only("naive")), "naive", F.col("chunk_no"), F.col("block_type"))
    manual = shape(manual_chunks(only("manual")), "manual", F.col("chunk_no"), F.col("block_type"))
    qa = shape(qa_chunks(only("qa")), "qa", F.col("chunk_no"), F.lit("qa"))
    table = shape(
        table_chunks(only("table")), "table", F.col("pos"), F.lit("table_row"), F.col("row_index")
    )
    bad = (
        routed.filter(~F.col("chunker").isin(CHUNKER_TYPES))
        .select("file_id", F.lit("unsupported").alias("chunker"))
        .distinct()
        .select(
            "file_id", "chunker", F.lit(-1).cast("long").alias("chunk_no"), F.lit(0).cast("long").alias("row_no"),
            F.lit("").alias("text"), F.lit("error").alias("block_type"),
        )
    )
    return naive.unionByName(manual).unionByName(qa).unionByName(table).unionByName(bad)


def section_stack(blocks: DataFrame) -> DataFrame:
    """Adds ``section_path`` and ``skipped`` by heading level, folded over a file's titles.

    The stack is cut to ``level - 1`` entries before a title is pushed; only the titles take part
    in the fold, the other blocks look their last title up.
    """
    order = W.partitionBy("file_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    is_title = (F.col("block_type") == "title") & (tx.compact(F.col("text")) != "")
    numbered = blocks.withColumn("title_no", F.sum(F.when(is_title, 1).otherwise(0)).over(order))
    titles = numbered.filter(is_title).select("file_id", "title_no", tx.compact(F.col("text")).alias("title"), "level")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        stack, paths = [], []
        for title, level in zip(*[pdf.sort_values("title_no")[c] for c in ("title", "level")]):
            del stack[max(int(level) - 1, 0):]
            stack.append(title)
            paths.append(list(stack))
        return pd.DataFrame(
            {"file_id": pdf["file_id"].iloc[0], "title_no": sorted(pdf["title_no"]), "section_path": paths}
        )

    key = blocks.schema["file_id"].dataType.simpleString()
    paths = titles.groupBy("file_id").applyInPandas(
        fold, f"file_id {key}, title_no long, section_path array<string>"
    )
    skip = F.lower(F.element_at("section_path", -1)).rlike(SKIP_SECTION_PATTERN)
    return numbered.join(paths, ["file_id", "title_no"], "left").withColumn(
        "skipped", F.coalesce(skip, F.lit(False))
    )


def kb_blocks(blocks: DataFrame) -> DataFrame:
    """Knowledge-base blocks: sections applied, noise and low-value sections dropped, neighbouring
    text of one page and section merged; tables, figures and formulas stay on their own, without a
    text as well if they have an asset (column ``asset_paths``, where there is one)."""
    if "asset_paths" not in blocks.columns:
        blocks = blocks.withColumn("asset_paths", F.create_map().cast("map<string,string>"))
    kind = tx.kb_block_type(F.col("block_type"))
    kept = (
        section_stack(blocks)
        .withColumn("kind", kind)
        .filter(~F.col("kind").isin("title", "noise"))
        .filter(~(F.col("skipped") & F.col("kind").isin("text", "table")))
        .filter((F.col("text") != "") | ((F.col("kind") != "text") & (F.size(F.map_keys("asset_paths")) > 0)))
    )
    order = W.partitionBy("file_id").orderBy("pos")
    island = F.when(
        (F.col("kind") == "text")
        & (F.lag("kind").over(order) == "text")
        & F.lag("title_no").over(order).eqNullSafe(F.col("title_no"))
        & F.lag("page_number").over(order).eqNullSafe(F.col("page_number")),
        0,
    ).otherwise(1)
    grouped = kept.withColumn("__new", island).withColumn(
        "block_no", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - 1
    )
    rows = F.sort_array(F.collect_list(F.struct("pos", "text")))
    return grouped.groupBy("file_id", "block_no", "kind").agg(
        F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("text"),
        F.min("page_number").alias("page_number"),
        F.array_join(F.min_by("section_path", "pos"), " > ").alias("section"),
        F.min_by(F.map_entries("asset_paths"), "pos").alias("assets"),
        F.count(F.lit(1)).alias("merged"),
    )


def split_message(text: Column, limit: int = 1800) -> Column:
    """Parts of at most ``limit`` characters, whole lines kept together where they fit.

    Lines are first cut to pieces of the limit; a fold then joins neighbouring pieces. A full-size
    piece always stands alone. Blank text becomes one placeholder part.
    """
    lines = F.split(F.regexp_replace(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", "\n"), "\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    pieces = F.flatten(
        F.transform(
            lines,
            lambda line: F.transform(
                F.sequence(F.lit(0), F.floor(F.greatest(F.length(line) - 1, F.lit(0)) / limit).cast("int")),
                lambda i: F.substring(line, i * limit + 1, F.lit(limit)),
            ),
        )
    )
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def close(acc):
        return F.when(F.coalesce(acc["open"], F.lit("")) != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])

    def step(acc, p):
        is_open = F.coalesce(acc["open"], F.lit("")) != ""
        fits = is_open & (F.length(acc["open"]) + F.length(p) + 1 <= limit)
        full = F.length(p) == limit
        return F.struct(
            F.when(full, F.array_append(close(acc), p)).when(fits | ~is_open, acc["done"]).otherwise(close(acc)).alias("done"),
            F.when(full, F.lit(None).cast("string")).when(fits, F.concat(acc["open"], F.lit("\n"), p)).otherwise(p).alias("open"),
        )

    folded = F.aggregate(pieces, start, step, close)
    return (
        F.when(tx.blank(text), F.array(F.lit("...")))
        .when(F.length(text) <= limit, F.array(text))
        .otherwise(folded)
    )
