"""Token ids in binary shards: fixed-size id blocks, transposed into bit or byte planes, each compressed by zstandard.

A shard is: magic, planes of chunk 0, planes of chunk 1, ..., document table, index, 8-byte length of the
index, magic. The index (JSON, zstandard) gives for each chunk its place, number of ids, first id's
position and the lengths of its planes. Documents stand in ascending id order, over shards too.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, WordCoder, bounded

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
NO_ID = -(1 << 63)  # stands for a null id in shards


def split_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    """Planes of unsigned 32-bit ids, lowest first, without the empty high ones."""
    most = int(ids.max(initial=0))
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        n = max(1, -(-most.bit_length() // 8))
        return [np.ascontiguousarray(octets[:, k]).tobytes() for k in range(n)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")[:, : max(1, most.bit_length())]
    return [row.tobytes() for row in np.packbits(np.ascontiguousarray(bits.T), axis=1)]


def join_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    if unit == "byte":
        octets = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            octets[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return octets.reshape(-1).view("<u4")


class ShardWriter:
    def __init__(self, out, block: int = BLOCK, unit: str = "byte", level: int = 3):
        self.out, self.block, self.unit = out, block, unit
        self.pack = zstandard.ZstdCompressor(level=level)
        self.at, self.n, self.index = len(MAGIC), 0, []
        self.held: list[bytes] = []
        self.held_n = 0
        self.docs: list[int] = []
        self.lengths: list[int] = []
        out.write(MAGIC)

    def add(self, doc: int, ids: bytes) -> None:
        """A document's ids as little-endian unsigned 32-bit integers."""
        self.docs.append(doc)
        self.lengths.append(len(ids) // 4)
        self.held.append(ids)
        self.held_n += len(ids) // 4
        if self.held_n >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        whole = len(ids) if last else len(ids) // self.block * self.block
        for a in range(0, whole, self.block):
            part = ids[a : min(a + self.block, whole)]
            packed = [self.pack.compress(p) for p in split_planes(part, self.unit)]
            self.index.append([self.at, len(part), self.n, [len(p) for p in packed]])
            for p in packed:
                self.out.write(p)
                self.at += len(p)
            self.n += len(part)
        self.held, self.held_n = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        table = self.pack.compress(np.array([self.docs, self.lengths], "<i8").tobytes())
        index = self.pack.compress(json.dumps({"unit": self.unit, "block": self.block, "ids": self.n, "docs": len(self.docs), "table": [self.at, len(table)], "chunks": self.index}).encode())
        self.out.write(table + index + struct.pack("<q", len(index)) + MAGIC)


class ShardReader:
    """Reads a shard by its index: documents() in order, or ids(a, b) of any range."""

    def __init__(self, f):
        self.f = f
        size = f.seek(0, 2) or f.tell()
        f.seek(size - 16)
        (n,), magic = struct.unpack("<q", f.read(8)), f.read(8)
        if magic != MAGIC:
            raise ValueError("not an id shard")
        f.seek(size - 16 - n)
        self.head = json.loads(zstandard.ZstdDecompressor().decompress(f.read(n)))
        at, n = self.head["table"]
        f.seek(at)
        self.docs, self.lengths = np.frombuffer(zstandard.ZstdDecompressor().decompress(f.read(n)), "<i8").reshape(2, -1)

    def chunk(self, k: int) -> np.ndarray:
        at, n, _, sizes = self.head["chunks"][k]
        self.f.seek(at)
        raw, planes, d = self.f.read(sum(sizes)), [], zstandard.ZstdDecompressor()
        a = 0
        for s in sizes:
            planes.append(d.decompress(raw[a : a + s]))
            a += s
        return join_planes(planes, n, self.head["unit"])

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, "<u4")
        block = self.head["block"]
        got = np.concatenate([self.chunk(k) for k in range(start // block, -(-stop // block))])
        return got[start - start // block * block : stop - start // block * block]

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(id, position of the first id in the shard, ids); one chunk and one document are held."""
        k, held, at = 0, np.zeros(0, "<u4"), 0
        for doc, n in zip(self.docs.tolist(), self.lengths.tolist()):
            parts, need = [], n
            while need > len(held):
                parts.append(held)
                need -= len(held)
                held = self.chunk(k)
                k += 1
            parts.append(held[:need])
            held = held[need:]
            yield doc, at, np.concatenate(parts)
            at += n


@lru_cache(2)
def hf_coder(path: str) -> WordCoder:
    """Ids of texts by the tokenizers library as its file sets it; one coder with its memory of words a worker process.

    A text that may hold an added token's content goes to the library whole, which gives it that token's id. New words of letters alone go to the library in one string, and its ids are cut where words begin
    or end; if that doesn't give as many words, and for all others, each goes by itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    suffix = json.loads(t.to_str())["model"].get("end_of_word_suffix")
    # in any case, since a token may be looked for in normalized text; the last three are all that NFC makes ASCII
    contents = [re.escape(x.content) for x in t.get_added_tokens_decoder().values()]
    added = f"(?i:{'|'.join(contents)})|[\u037e\u1fef\u212a]" if contents else None
    edge = np.zeros(t.get_vocab_size(), bool)  # of the ids that end a word, or begin one after a blank
    for token, i in t.get_vocab().items():
        edge[i] = token.endswith(suffix) if suffix else token.startswith("\u0120")

    def apart(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(texts, add_special_tokens=False)]

    def words(keys: list[str]) -> list[bytes]:
        plain = [k for k in keys if k.isalpha()]
        got: dict[str, bytes] = {}
        if len(plain) > 4:
            ids = np.array(t.encode_batch_fast([" " + " ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(edge[ids])
            if len(at) == len(plain):
                cuts = [0, *(at + 1).tolist()] if suffix else [*at.tolist(), len(ids)]
                raw = ids.tobytes()
                got = {k: raw[4 * a : 4 * b] for k, a, b in zip(plain, cuts, cuts[1:])}
        rest = [k for k in keys if k not in got]
        got.update(zip(rest, apart(rest if suffix else [" " + k for k in rest])))
        return [got[k] for k in keys]

    return WordCoder(apart, blanks=suffix is None, encode_words=words, whole=added)


def hf_ids(texts: pa.Array | list, path: str) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""
    return hf_coder(path).batch(texts)


def write_ids(df: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", unit: str = "byte", block: int = BLOCK, shards: int | None = None) -> list[dict]:
    """Encodes whole texts and writes shards in ascending id order to a shared folder; returns the manifest.

    One task writes one shard under a name of its own and the manifest names those of the tasks that
    ended, so a task that runs twice does no harm. The manifest has a row a shard. Rows with a null
    id come first, as the least id would; equal ids keep the order of their texts' hashes.
    """
    spark = df.sparkSession
    fs_path = folder
    texts = df.select(F.coalesce(df[id_col].cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = texts.repartitionByRange(n, "id").sortWithinPartitions("id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        writer = out = name = None
        fs = None
        for b in bounded(batches):
            for i, raw in zip(b.column(0).to_pylist(), hf_ids(b.column(1), tokenizer)):
                if writer is None:
                    fs, base = pafs.FileSystem.from_uri(fs_path)
                    fs.create_dir(base, recursive=True)
                    name = f"{base}/ids-{uuid.uuid4().hex}.idp"
                    out = fs.open_output_stream(name)
                    writer = ShardWriter(out, block, unit)
                writer.add(i, raw + end)
        if writer:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name.rpartition("/")[2]], "first": [writer.docs[0]], "last": [writer.docs[-1]], "docs": [len(writer.docs)], "ids": [writer.n], "bytes": [out_size(fs, name)]})

    def out_size(fs, name):
        return fs.get_file_info(name).size

    rows = ordered.mapInArrow(run, "path string, first long, last long, docs long, ids long, bytes long").collect()
    manifest, at = [], 0
    for r in sorted(rows, key=lambda r: (r["first"], r["last"])):
        manifest.append({"path": f"{folder}/{r['path']}", **{k: r[k] for k in ("first", "last", "docs", "ids", "bytes")}, "start": at})
        at += r["ids"]
    return manifest


def read_ids(spark, manifest: list[dict], id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids array<long> or, with digest, ids_crc32) read back from the shards."""
    kind = "ids_crc32 long" if digest else "ids array<long>"
    schema = f"id long, start long, n_tokens long, {kind}"
    if not manifest:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)

    def batch(rows):
        cols = list(zip(*rows))
        last = pa.array(cols[3], pa.int64() if digest else pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), last], names=["id", "start", "n_tokens", kind.split()[0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as f:
                    rows = []
                    for doc, at, ids in ShardReader(f).documents():
                        rows.append((doc, start + at, len(ids), zlib.crc32(ids.tobytes()) if digest else ids.astype(np.int64)))
                        if len(rows) == BATCH_ROWS:
                            yield batch(rows)
                            rows = []
                    if rows:
                        yield batch(rows)

    shards = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start long")
    got = shards.repartition(len(manifest)).mapInArrow(run, schema)
    return got.withColumn("id", F.nullif(F.col("id"), F.lit(NO_ID))).withColumnRenamed("id", id_col)
