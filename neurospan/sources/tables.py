"""Sources and sinks: files of tables, JSON, key-value stores, binary buffers and skeletons."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT_CSV = "x int, y int, z int, kind string, conf float, user string, label long, body long, sv long"
SWC = "node int, kind int, x float, y float, z float, radius float, parent int"


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv_header(spark: SparkSession, path: str) -> list[str] | None:
    """Names of a CSV's first line, or None if a value of it is a number."""
    first = spark.read.csv(path, header=False).limit(1).collect()
    if not first:
        return None
    values = [str(v or "").strip() for v in first[0]]

    def number(v: str) -> bool:
        try:
            float(v)
        except ValueError:
            return False
        return True

    return None if any(map(number, values)) else values


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with or without a header line, by a declared schema."""
    return spark.read.csv(path, schema=schema, header=csv_header(spark, path) is not None)


def read_ids(spark: SparkSession, path: str, name: str = "body") -> DataFrame:
    """The first column of a CSV as ids."""
    df = spark.read.csv(path, header=csv_header(spark, path) is not None)
    return df.select(F.col(f"`{df.columns[0]}`").cast("long").alias(name))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of files that each hold a JSON array, or a JSON object a line."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A table over JDBC, read in ranges of a column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def list_files(spark: SparkSession, path: str, pattern: str = "*", expr: str | None = None, skip: str | None = None) -> DataFrame:
    """(path, length, modificationTime) of files below a folder, without their contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    files = files.where(F.col("path").rlike(expr)) if expr else files
    return files.where(~F.col("path").rlike(skip)) if skip else files


def count_files(files: DataFrame, root: str) -> DataFrame:
    """(folder, files) of every folder above listed files, up to the root."""
    parts = F.split(F.regexp_replace(F.expr(f"substring(path, length('{root}') + 1)"), "^/+", ""), "/")
    up = files.select(F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("k"), parts.alias("p"))
    return up.select(F.array_join(F.slice("p", 1, F.col("k")), "/").alias("folder")).groupBy("folder").agg(F.count("*").alias("files"))


def keyvalues(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, value): a row's columns as JSON under its key."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*columns)).alias("value"))


def from_keyvalues(kv: DataFrame, key: str, schema: str) -> DataFrame:
    return kv.select(F.col("key").cast("long").alias(key), F.from_json("value", schema).alias("v")).select(key, "v.*")


def read_swc(spark: SparkSession, path: str) -> DataFrame:
    """Skeleton nodes of SWC files, with their file."""
    lines = spark.read.text(path).withColumn("path", F.input_file_name()).where("NOT value LIKE '#%' AND trim(value) != ''")
    f = F.split(F.trim("value"), r"\s+")
    names = [c.split() for c in SWC.split(", ")]
    return lines.select("path", *(f[k].cast(t).alias(n) for k, (n, t) in enumerate(names)))


def swc_lines(skeleton: DataFrame, key: str = "body") -> DataFrame:
    """(key, value) lines of SWC files."""
    return skeleton.select(F.col(key).cast("string").alias("key"), F.concat_ws(" ", *(F.col(c.split()[0]).cast("string") for c in SWC.split(", "))).alias("value"))


def encode_run_payload(runs: DataFrame, key: str = "body") -> DataFrame:
    """(key, data): runs as a buffer of header, number of runs, and x, y, z, length as little-endian 32-bit integers."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["z", "y", "x0"])
        head = bytes([0, 3, 0, 0]) + np.array([0, len(pdf)], "<u4").tobytes()
        body = np.stack([pdf.x0, pdf.y, pdf.z, pdf.x1 - pdf.x0 + 1], axis=1).astype("<i4").tobytes()
        return pd.DataFrame({key: [pdf[key].iloc[0]], "data": [head + body]})

    return runs.select(key, "z", "y", "x0", "x1").groupBy(key).applyInPandas(run, f"{key} long, data binary")


def decode_run_payload(payloads: DataFrame, key: str = "body") -> DataFrame:
    """Runs (key, z, y, x0, x1) of such buffers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for k, data in zip(pdf[key], pdf["data"]):
                raw = bytes(data)
                n = int(np.frombuffer(raw, "<u4", 1, 8)[0])
                x, y, z, m = np.frombuffer(raw, "<i4", 4 * n, 12).reshape(n, 4).T
                yield pd.DataFrame({key: k, "z": z, "y": y, "x0": x, "x1": x + m - 1})

    return payloads.select(key, "data").mapInPandas(run, f"{key} long, z int, y int, x0 int, x1 int")


def gzipped(c: str, name: str, df: DataFrame, inverse: bool = False) -> DataFrame:
    """Adds a column with another's bytes (un)packed by gzip."""

    @F.pandas_udf("binary")
    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else gzip.decompress(b) if inverse else gzip.compress(bytes(b), mtime=0))

    return df.withColumn(name, pack(F.col(c).cast("binary")))


def flatten_index(index: DataFrame) -> DataFrame:
    """(label, z, y, x, sv, count) of label indexes (label, blocks map<block id, map<sv, count>>)."""
    from ..functions.coords import unpack_aligned_block

    rows = index.select("label", F.explode("blocks").alias("block", "counts")).select("label", "block", F.explode("counts").alias("sv", "count"))
    z, y, x = unpack_aligned_block("block")
    return rows.select("label", z.alias("z"), y.alias("y"), x.alias("x"), "sv", "count")


def nest_index(flat: DataFrame) -> DataFrame:
    """Label indexes of flat rows."""
    from ..functions.coords import pack_aligned_block

    per = flat.withColumn("block", pack_aligned_block("z", "y", "x")).groupBy("label", "block").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sv", "count")))).alias("counts"))
    return per.groupBy("label").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("block", F.map_entries("counts").alias("e"))))).alias("b")).select("label", F.transform_values("b", lambda _, e: F.map_from_entries(e)).alias("blocks"))


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite", rows_per_file: int = 0) -> None:
    out = df.write.mode(mode)
    out = out.partitionBy(*by) if by else out
    (out.option("maxRecordsPerFile", rows_per_file) if rows_per_file else out).parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table whose later joins on the key need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
