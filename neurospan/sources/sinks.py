"""Sinks: layouts of exported tables and writers of JSON, CSV and partitioned files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_relationships(weights: DataFrame) -> DataFrame:
    """body, rel, to_body, roi, weight first, then the other columns."""
    first = [c for c in ("body", "rel", "to_body", "roi", "weight") if c in weights.columns]
    return weights.select(*first, *(c for c in weights.columns if c not in first)).orderBy(*first[:-1])


def export_inputs_outputs(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights of what bodies receive, and of what they send."""
    split = lambda rel: weights.where(F.col("rel") == rel).drop("rel")
    return split("PostSynTo"), split("PreSynTo")


def export_pre_post(weights: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a pair (and roi) in pre and post columns, whichever side said it; columns come in pairs c and to_c."""
    swap = F.col("rel") == "PostSynTo"
    pairs = [("body", "to_body"), *((c, f"to_{c}") for c in columns or [])]
    out = []
    for a, b in pairs:
        out += [F.when(swap, F.col(b)).otherwise(F.col(a)).alias(f"{a}_pre"), F.when(swap, F.col(a)).otherwise(F.col(b)).alias(f"{a}_post")]
    roi = ["roi"] if "roi" in weights.columns else []
    return weights.select(*out, *roi, "weight").dropDuplicates(["body_pre", "body_post", *roi])


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_array(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(value): one JSON array with an object a line, in order; for tables that fit a row."""
    rows = df.groupBy().agg(F.array_sort(F.collect_list(F.struct(*order, F.to_json(F.struct(*columns)).alias("_j")))).alias("r"))
    return rows.select(F.concat(F.lit("[\n"), F.array_join(F.transform("r", lambda x: x["_j"]), ",\n"), F.lit("\n]")).alias("value"))


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, header=header)


def write_by_key(df: DataFrame, path: str, key: str, order: list[str], files: int = 0) -> None:
    """Files in which a key's rows stand together and in order; keys are dealt by range, so each file has a range of them."""
    dealt = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    dealt.sortWithinPartitions(key, *order).write.mode("overwrite").parquet(path)


def element_documents(full: DataFrame, log2: int = 6) -> DataFrame:
    """(block, doc): JSON elements of a full partner table by the pre point's block, each with its relations."""
    at = lambda s: F.array(*(F.col(f"{a}_{s}") for a in "xyz"))
    pre = full.groupBy("pre_id").agg(F.first(at("pre")).alias("Pos"), F.array_sort(F.collect_list(F.struct(F.lit("PreSynTo").alias("Rel"), at("post").alias("To")))).alias("Rels"))
    post = full.select(F.col("post_id").alias("pre_id"), at("post").alias("Pos"), F.array(F.struct(F.lit("PostSynTo").alias("Rel"), at("pre").alias("To"))).alias("Rels"))
    rows = pre.withColumn("Kind", F.lit("PreSyn")).unionByName(post.withColumn("Kind", F.lit("PostSyn")))
    block = F.concat_ws(",", *(F.shiftright(F.col("Pos")[k], log2).cast("string") for k in range(3)))
    return rows.groupBy(block.alias("block")).agg(F.array_sort(F.collect_list(F.to_json(F.struct("Pos", "Kind", "Rels")))).alias("e")).select("block", F.concat(F.lit("["), F.array_join("e", ","), F.lit("]")).alias("doc"))
