"""Streaming twins of the log operators and of windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.log import parse
from ..operators.tables import keep_one


def lines(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Log lines of files that come into a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def kafka_lines(spark: SparkSession, servers: str, topic: str, offsets: str = "earliest") -> DataFrame:
    """Log lines of a topic; needs the Kafka connector on the class path."""
    got = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", offsets).load()
    return got.select(F.col("value").cast("string").alias("value"))


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a Parquet path as a stream."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    schema = spark.read.parquet(path).schema
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def parsed(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Typed rows of a stream of lines; a message counts once within the delay."""
    return parse(stream, exact_duplicates=True).withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["uuid", "mutid", "msg"])


def tumbling(stream: DataFrame, time: str, width: str, keys: list[str], delay: str) -> DataFrame:
    got = stream.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
    return got.select(F.col("window.start").alias("start"), *keys, "n")


def sliding(stream: DataFrame, time: str, width: str, step: str, keys: list[str], delay: str) -> DataFrame:
    got = stream.withWatermark(time, delay).groupBy(F.window(time, width, step), *keys).agg(F.count("*").alias("n"))
    return got.select(F.col("window.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, time: str, gap: str, key: str, delay: str) -> DataFrame:
    got = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return got.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), key, "n")


def body_states(events: DataFrame) -> DataFrame:
    """(body, state, mutid) after each batch, by state kept for each body. events: (body, mutid, seq, event), in any order."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        first, last, at, since = state.get if state.exists else (None, None, None, None)
        for pdf in batches:
            for m, s, e in sorted(zip(pdf.mutid, pdf.seq, pdf.event)):
                if since is None or (m, s) < tuple(since):
                    first, since = e, [int(m), int(s)]
                if at is None or (m, s) >= tuple(at):
                    last, at = e, [int(m), int(s)]
        state.update((first, last, at, since))
        made, gone = first == "new", last == "removed"
        name = None if made and gone else "removed" if gone else "new" if made else "changed"
        yield pd.DataFrame({"body": [key[0]], "state": [name], "mutid": [at[0]]})

    return events.groupBy("body").applyInPandasWithState(run, "body long, state string, mutid long", "first string, last string, at array<long>, since array<long>", "update", "NoTimeout")


def into_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream to its present end into a table in memory, and returns that."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def into_table(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream to its present end into Parquet in the shared folder, and returns what holds then.

    complete: the last batch's rows; update: the last row of each key; append: all rows. A batch that runs
    again writes the same files, and nothing is gathered on the driver.
    """
    from ..operators.graph import shared_path

    spark, path = stream.sparkSession, shared_path(stream.sparkSession)
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/rows/batch=-1")

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/rows/batch={epoch}")

    stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/rows")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("batch"))
        return rows.join(F.broadcast(last), "batch").drop("batch")
    if mode == "update":
        others = [c for c in stream.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_last")).select(*(F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in stream.columns))
    return rows.drop("batch")


def into_files(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes a stream to Parquet, each row once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _held(spark: SparkSession, path: str, before: int | None = None) -> tuple[int | None, dict[int, int]]:
    """The last whole batch (before another) and the generation of each bucket after it: as many entries as buckets."""
    fs, root = _file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    done = sorted((int(n[5:]) for n in names if n.startswith("held=")), reverse=True)
    for e in done:
        if (before is None or e < before) and fs.exists(_file_system(spark, f"{path}/held={e}/_SUCCESS")[1]):
            return e, {r.bucket: r.g for r in spark.read.schema("bucket int, g long").json(f"{path}/held={e}").collect()}
    return None, {}


def upserts(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, buckets: int = 64):
    """Keeps the last row of each key, by the order, in buckets of a Parquet table; upserted() reads it.

    A batch writes anew only buckets that it has keys of, as path/g=batch/bucket=n, and lists each bucket's
    generation in path/held=batch. A batch that runs again reads what the one before it left and writes the same;
    generations that neither of the last two batches lists are removed. The number of buckets stays for a path.
    """
    spark, schema = stream.sparkSession, stream.schema
    number = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def batch(df: DataFrame, epoch: int) -> None:
        dealt = df.withColumn("bucket", number).persist()
        last, held = _held(spark, path, epoch)
        touched = sorted(r.bucket for r in dealt.select("bucket").distinct().collect())
        there = [f"{path}/g={held[b]}/bucket={b}" for b in touched if b in held]
        rows = dealt if not there else spark.read.schema(schema).parquet(*there).withColumn("bucket", number).unionByName(dealt)
        kept = keep_one(rows.repartition("bucket"), ["bucket", *keys], [order], last=True)
        kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/g={epoch}")
        now = held | dict.fromkeys(touched, epoch)
        spark.createDataFrame(sorted(now.items()), "bucket int, g long").coalesce(1).write.mode("overwrite").json(f"{path}/held={epoch}")
        dealt.unpersist()
        if last is not None:
            fs, _ = _file_system(spark, path)
            for b, g in _held(spark, path, last)[1].items():
                if g not in (held.get(b), now.get(b)):
                    fs.delete(_file_system(spark, f"{path}/g={g}/bucket={b}")[1], True)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows that upserts() holds after its last whole batch."""
    _, held = _held(spark, path)
    places = [f"{path}/g={g}/bucket={b}" for b, g in sorted(held.items())]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)
