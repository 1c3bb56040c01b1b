"""Files of viewers and of task tools as columns: skeleton buffers, segment properties, task lists, run payloads."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import csv_header, read_csv

ROWS = 100_000  # of nodes that are read together


def encode_skeletons(skeletons: DataFrame, resolution: float = 8.0, key: str = "body") -> DataFrame:
    """(key, buffer) of skeletons (key, node, x, y, z, parent): vertices in nanometres by rising node number, then edges of nodes and parents.

    Nodes are numbered from 0 in their order; a parent that isn't a node of the skeleton (-1, 0) is none. A
    skeleton is one row of the result, so it fits a task.
    """

    def made(nodes: list, parents: list, at: list[np.ndarray]) -> bytes:
        place = dict(zip(nodes, range(len(nodes))))
        edges = [(i, place[p]) for i, p in enumerate(parents) if p in place]
        return struct.pack("<2I", len(nodes), len(edges)) + (np.concatenate(at) * np.float32(resolution)).astype("<f4").tobytes() + np.array(edges, "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, parents, at = None, [], [], []  # a skeleton that may go on in the next batch
        for b in batches:
            keys, own, up = (b.column(k).to_pylist() for k in range(3))
            xyz = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype("<f4") for k in (3, 4, 5)], axis=1)
            starts = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
            out = []
            for i, j in zip(starts, [*starts[1:], len(keys)]):
                if nodes and keys[i] != last:
                    out.append((last, made(nodes, parents, at)))
                    nodes, parents, at = [], [], []
                last = keys[i]
                nodes += own[i:j]
                parents += up[i:j]
                at.append(xyz[i:j])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([d for _, d in out], pa.binary())], names=[key, "buffer"])
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([made(nodes, parents, at)], pa.binary())], names=[key, "buffer"])

    rows = skeletons.select(F.col(key).cast("long").alias(key), "node", "parent", "x", "y", "z")
    return rows.repartition(key).sortWithinPartitions(key, F.asc_nulls_last("node")).mapInArrow(run, f"`{key}` long, buffer binary")


def decode_skeletons(buffers: DataFrame, key: str = "body") -> DataFrame:
    """(key, node, x, y, z, parent) of buffers; positions stay in nanometres, nodes count from 0, roots have the parent -1. One of another length raises ValueError in its task."""

    def rows(held: list[tuple]) -> pa.RecordBatch:
        keys, at, parents = zip(*held)
        n = [len(p) for p in parents]
        at = np.concatenate(at)
        arrays = [pa.array(keys, pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.concatenate([np.arange(v) for v in n])), *(pa.array(np.ascontiguousarray(at[:, c])) for c in range(3)), pa.array(np.concatenate(parents))]
        return pa.RecordBatch.from_arrays(arrays, names=[key, "node", "x", "y", "z", "parent"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, m = struct.unpack_from("<2I", data) if len(data) >= 8 else (0, 0)
                if len(data) < 8 or len(data) != 8 + 12 * n + 8 * m:
                    raise ValueError(f"skeleton buffer of {len(data)} bytes is malformed, or has attributes of its vertices")
                at = np.frombuffer(data, "<f4", 3 * n, 8).reshape(-1, 3)
                edges = np.frombuffer(data, "<u4", 2 * m, 8 + 12 * n).reshape(-1, 2)
                parent = np.full(n, -1, np.int64)
                parent[edges[:, 0]] = edges[:, 1]
                held.append((k, at, parent))
                size += n
                if size >= ROWS:
                    yield rows(held)
                    held, size = [], 0
            if held:
                yield rows(held)

    return buffers.select(F.col(key).cast("long").alias(key), F.col("buffer").cast("binary").alias("buffer")).mapInArrow(run, f"`{key}` long, node long, x float, y float, z float, parent long")


_PROPERTIES = "inline struct<ids:array<string>, properties:array<struct<id:string, type:string, data_type:string, values:array<string>, tags:array<string>>>>"


def segment_properties(documents: DataFrame, column: str = "document") -> DataFrame:
    """(segment, property, type, data_type, value) of property documents: a row for each value of a segment.

    A tag is a row of the type tags with the tag as property and true as value; segments have no rows for tags
    that they lack. Documents list all values in memory, so one is one row here too.
    """
    parsed = documents.select(F.from_json(F.col(column), _PROPERTIES).alias("d")).select("d.inline.*")
    each = parsed.select("ids", F.explode("properties").alias("p"))
    rows = each.select("p", F.posexplode("ids").alias("at", "segment"))
    value = F.get("p.values", F.col("at"))
    own = rows.select(F.col("segment").cast("long").alias("segment"), F.col("p.id").alias("id"), F.col("p.type").alias("type"), F.col("p.data_type").alias("data_type"), F.col("p.tags").alias("tags"), value.alias("value"))
    scalar = own.where("type != 'tags'").select("segment", F.col("id").alias("property"), "type", "data_type", "value")
    codes = own.where("type = 'tags'").select("segment", "tags", "type", "data_type", F.explode(F.from_json("value", "array<int>")).alias("code"))
    return scalar.unionByName(codes.select("segment", F.get("tags", F.col("code")).alias("property"), "type", "data_type", F.lit("true").alias("value")))


def property_columns(rows: DataFrame, columns: dict[str, str], tags: list[str] | None = None) -> DataFrame:
    """One row a segment of segment_properties(): the named properties as columns of the named types, tags as booleans."""
    of = lambda c: F.max(F.when((F.col("type") != "tags") & (F.col("property") == c), F.col("value")))
    flag = lambda t: F.coalesce(F.bool_or((F.col("type") == "tags") & (F.col("property") == t)), F.lit(False))
    return rows.groupBy("segment").agg(*(of(c).cast(t).alias(c) for c, t in columns.items()), *(flag(t).alias(t) for t in tags or []))


EDGE_COLUMNS = ("sv_a", "sv_b", "xa", "ya", "za", "xb", "yb", "zb")


def read_edge_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An edge table from CSV with a header, or from Parquet; ValueError if it lacks columns of an edge."""
    if path.rstrip("/").endswith(".csv"):
        if csv_header(spark, path) is None:
            raise ValueError(f"no header: {path}")
        out = read_csv(spark, path, schema)
    else:
        out = spark.read.parquet(path)
    if lacking := [c for c in EDGE_COLUMNS if c not in out.columns]:
        raise ValueError(f"{path} lacks {lacking}")
    return out


def _task(edges: DataFrame) -> tuple[DataFrame, Column]:
    """Edges with sv_a and sv_b, and a task as a struct, the lower id first."""
    names = {"id_a": "sv_a", "id_b": "sv_b"}
    if any(a in edges.columns and b in edges.columns for a, b in names.items()):
        raise ValueError("either id_a and id_b or sv_a and sv_b")
    end = lambda s: F.struct(F.col(f"sv_{s}").cast("long").alias("sv"), F.array(*(F.col(f"{c}{s}").cast("int") for c in "xyz")).alias("at"))
    swap = F.col("sv_a") > F.col("sv_b")
    lo, hi = F.when(swap, end("b")).otherwise(end("a")), F.when(swap, end("a")).otherwise(end("b"))
    task = F.struct(F.lit("body merge").alias("task type"), lo["sv"].alias("supervoxel ID 1"), lo["at"].alias("supervoxel point 1"), hi["sv"].alias("supervoxel ID 2"), hi["at"].alias("supervoxel point 2"))
    return edges.withColumnsRenamed(names), task


def edge_tasks(edges: DataFrame) -> DataFrame:
    """(task) of edges (sv_a, sv_b, xa, ..., zb), or with id_a and id_b in place of sv_a and sv_b: a JSON object an edge."""
    rows, task = _task(edges)
    return rows.select(F.to_json(task).alias("task"))


def task_lists(edges: DataFrame, order: list[str], size: int) -> DataFrame:
    """(list, document): task lists of about `size` edges in an order, as JSON documents.

    n edges are dealt to n // size lists of like length; what is left makes one more.
    """
    from ..operators.tables import numbered

    total = edges.count()
    per = max(1, total // max(1, total // size))
    rows, task = _task(numbered(edges, order, "_n"))
    listed = rows.groupBy(F.floor(F.col("_n") / per).alias("list")).agg(F.array_sort(F.collect_list(F.struct("_n", task.alias("task")))).alias("all"))  # at most 2 * size each
    return listed.select("list", F.to_json(F.struct(F.lit("Neu3 task list").alias("file type"), F.lit(1).alias("file version"), F.col("all.task").alias("task list"))).alias("document"))


_TASK = "`supervoxel ID 1` long, `supervoxel ID 2` long, `supervoxel point 1` array<int>, `supervoxel point 2` array<int>"


def parse_task_lists(documents: DataFrame, extra: str = "", column: str = "document") -> DataFrame:
    """(sv_a, sv_b, xa, ya, za, xb, yb, zb, extra...) of task lists; extra names further fields of tasks with their types, which keep their names."""
    task = _TASK + (f", {extra}" if extra else "")
    parsed = documents.select(F.explode(F.from_json(F.col(column), "`task list` array<struct<" + ", ".join(f"{f.rsplit(' ', 1)[0]}:{f.rsplit(' ', 1)[1]}" for f in task.split(", ")) + ">>")["task list"]).alias("t"))
    at = lambda side, k: F.get(F.col(f"t.`supervoxel point {side}`"), F.lit(k))
    points = [at(s, k).alias(f"{c}{e}") for s, e in ((1, "a"), (2, "b")) for k, c in enumerate("xyz")]
    names = [f.rsplit(" ", 1)[0].strip("`") for f in extra.split(", ")] if extra else []
    return parsed.select(F.col("t.`supervoxel ID 1`").alias("sv_a"), F.col("t.`supervoxel ID 2`").alias("sv_b"), *points, *(F.col(f"t.`{n}`").alias(n) for n in names))


def run_payload_facts(payloads: DataFrame, key: str = "body", payload: str = "payload") -> DataFrame:
    """(key, voxels, z, y, x): size and first place of run payloads: a head of 12 bytes, then x, y, z and length of each run. One of another length raises ValueError in its task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, data in zip(b[key], b[payload]):
                data = bytes(data)
                if len(data) < 28 or (len(data) - 12) % 16:
                    raise ValueError(f"run payload of {len(data)} bytes")
                runs = np.frombuffer(data, "<i4", offset=12).reshape(-1, 4)
                out.append((k, int(runs[:, 3].sum(dtype=np.int64)), *runs[0, 2::-1].tolist()))
            yield pd.DataFrame(out, columns=[key, "voxels", "z", "y", "x"])

    return payloads.select(key, payload).mapInPandas(run, f"`{key}` long, voxels long, z long, y long, x long")
