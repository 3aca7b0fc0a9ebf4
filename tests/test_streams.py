"""Streaming jobs that fold batches: equal to the batch form, replayed batches, bounded reads."""

import os

from pyspark.sql import functions as F

from loreframe.plans.streams import staged_rows
from loreframe.scale import latest_per_key
from loreframe.sources.tables import Tables
from loreframe.streaming import jobs

ROWS = "id string, at long, value long"


def add_files(spark, folder, numbers):
    """One file for each number; ids repeat, later files also bring older changes."""
    for n in numbers:
        rows = [(f"k{(n * 7 + i) % 11}", (n * 13 + i * 5) % 97 * 1000 + n * 10 + i, n) for i in range(6)]
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(folder)


def files(spark, folder):
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(folder)


def last(rows):
    return latest_per_key(rows, ["id"], [F.col("at")])


def totals(rows):
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def add_totals(parts):
    return parts.groupBy("id").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))


def same(got, want):
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_folded_equals_batch_after_every_number_of_batches(spark, tmp_path):
    folder, outs = str(tmp_path / "in"), [str(tmp_path / "latest"), str(tmp_path / "totals")]
    done = 0
    for step in (1, 1, 1, 3, 5):
        add_files(spark, folder, range(done, done + step))
        done += step
        everything = spark.read.schema(ROWS).parquet(folder)
        same(jobs.run_folded(files(spark, folder), "l", last, last, every=3, out=outs[0]), last(everything))
        same(jobs.run_folded(files(spark, folder), "t", totals, add_totals, every=3, out=outs[1]), totals(everything))
    again = jobs.run_folded(files(spark, folder), "t", totals, add_totals, every=3, out=outs[1])
    same(again, totals(spark.read.schema(ROWS).parquet(folder)))  # nothing new


def test_a_replayed_batch_counts_once(spark, tmp_path):
    """The last batch is run again as after a lost driver, once with and once without a merge in it."""
    for count in (6, 7):
        folder, out = str(tmp_path / f"in{count}"), str(tmp_path / f"out{count}")
        add_files(spark, folder, range(count))
        jobs.run_folded(files(spark, folder), "t", totals, add_totals, every=3, out=out)
        commits = f"{out}/state/commits"
        os.remove(f"{commits}/{count - 1}")
        crc = f"{commits}/.{count - 1}.crc"
        if os.path.exists(crc):
            os.remove(crc)
        got = jobs.run_folded(files(spark, folder), "t", totals, add_totals, every=3, out=out)
        same(got, totals(spark.read.schema(ROWS).parquet(folder)))


def test_reads_stay_in_proportion_to_keys(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    add_files(spark, folder, range(14))
    got = jobs.run_folded(files(spark, folder), "l", last, last, every=3, out=out)
    read = {os.path.relpath(f.split("file:")[-1].replace("///", "/"), out).rsplit("/", 1)[0] for f in got.inputFiles()}
    assert read == {"merged/11", "batches/12", "batches/13"}
    assert spark.read.parquet(f"{out}/batches/3").count() == 0  # replaced two merges ago


def test_empty_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([], ROWS).write.parquet(folder)
    empty = spark.readStream.schema(ROWS).parquet(str(tmp_path / "in"))
    assert jobs.run_folded(empty, "t", totals, add_totals).count() == 0


def test_index_keeps_the_newest_change_whatever_the_order(spark, tmp_path):
    folder, rows = str(tmp_path / "in"), "id string, text string, updated_at long"
    for n, (text, at) in enumerate([("new words", 5), ("old words", 2)]):
        spark.createDataFrame([("a", text, at)], rows).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows).option("maxFilesPerTrigger", 1).parquet(folder)
    assert [r.updated_at for r in jobs.index_rows(stream, "text").collect()] == [5]


def test_staged_files_are_bounded_and_come_in_two_batches(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 2).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit("x"), 250).alias("text"))
    path, stream = staged_rows(Tables(spark, str(tmp_path)), rows, "staged", file_bytes=100_000)
    held = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.sum(F.octet_length("text")).alias("bytes")).collect()
    assert len(held) == 11 and max(r["bytes"] for r in held) <= 110_000
    taken = []
    query = stream.writeStream.foreachBatch(lambda batch, n: taken.append(batch.count())).trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    assert len(taken) == 2 and sum(taken) == 4000
