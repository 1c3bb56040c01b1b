"""Byte-level BPE by a two-tier lookup: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

Results are those of the usual rank-based encoder, which also tries the whole pre-token first and
otherwise merges the adjoining pair of lowest rank, leftmost first.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import WordCoder, bounded


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Hash and displace: keys to 0..n-1 without gaps; each slot keeps its key, so strangers are told apart."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        n = len(keys)
        self.n, self.m = n, max(1, -(-n // per_bucket))
        self.shift = np.zeros(self.m, np.int64)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(hashes)) != n:
            raise ValueError("keys repeat or their hashes collide")
        self.slot_of = np.zeros(n, np.int64)
        buckets: list[list[int]] = [[] for _ in range(self.m)]
        for i, b in enumerate((hashes % np.uint64(self.m)).tolist()):
            buckets[b].append(i)
        taken = bytearray(n)
        values = hashes.tolist()
        for b in sorted(range(self.m), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if len(own) < 2:
                break
            d = 0
            while True:
                slots = [self._slot(values[i], d) for i in own]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for i, s in zip(own, slots):
                taken[s] = 1
                self.slot_of[i] = s
        free = (s for s in range(n) if not taken[s])
        for b, own in enumerate(buckets):
            if len(own) == 1:  # a bucket of one key names its slot itself
                self.slot_of[own[0]] = s = next(free)
                self.shift[b] = ~s
        self.keys: list[bytes] = [b""] * n
        for i, s in enumerate(self.slot_of.tolist()):
            self.keys[s] = keys[i]
        self.shifts = self.shift.tolist()

    def _slot(self, h: int, d: int) -> int:
        if d < 0:
            return ~d
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (x ^ (x >> 32)) % self.n

    def find(self, key: bytes) -> int:
        """The slot of a key, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        s = self._slot(h, self.shifts[h % self.m])
        return s if self.keys[s] == key else -1


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        keys = list(ranks)
        self.table = PerfectHash(keys)
        self.ids = [0] * len(keys)
        for k, s in zip(keys, self.table.slot_of.tolist()):
            self.ids[s] = ranks[k]
        self.pairs = ranks  # of the second tier, which asks for pairs of parts
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, r in ranks.items():
            self.bytes_of[r] = k
        self.split = regex.compile(pattern)

    def rank(self, piece: bytes) -> int:
        s = self.table.find(piece)
        return -1 if s < 0 else self.ids[s]

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token that isn't in the vocabulary: pairs wait in a heap, parts hang in a linked list."""
        n, rank_of = len(word), self.pairs.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank_of(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, size = pop(heap)
            own = part[i]
            if own is None or (j := right[i]) >= n or len(own) + len(part[j]) != size:
                continue  # one of the two has merged otherwise since
            part[i] = own = own + part[j]
            part[j] = None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := rank_of(own + part[k])) is not None:
                    push(heap, (r, i, size + len(part[k])))
            if (h := left[i]) >= 0 and (r := rank_of(part[h] + own)) is not None:
                push(heap, (r, h, len(part[h]) + size))
        try:
            return [self.pairs[p] for p in part if p is not None]
        except KeyError as e:
            raise ValueError(f"no id for byte {e}") from None

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self.split.findall(text):
            raw = word.encode("utf-8")
            r = self.rank(raw)
            out += [r] if r >= 0 else self.merge(raw)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def load(path: str, pattern: str) -> tuple[ByteBpe, WordCoder]:
    """One encoder with its memory of words a worker process."""
    bpe = ByteBpe(read_ranks(path), pattern)
    return bpe, WordCoder(lambda texts: [np.array(bpe.encode(t), "<i4").tobytes() for t in texts], blanks=True)


def ids_of(text: str, path: str, pattern: str) -> list[int]:
    return np.frombuffer(load(path, pattern)[1].batch([text])[0], "<i4").tolist()


def encode_texts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of whole texts; null counts as empty and has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, coder = load(path, pattern)
        for b in bounded(batches):
            raw = coder.batch(b.column(1))
            ends = np.cumsum([0, *(len(r) // 4 for r in raw)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["id", "ids"])

    got = df.select(df[id_col].cast("long").alias("id"), df[text_col]).mapInArrow(run, "id long, ids array<int>")
    return got.withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids", digest: bool = False) -> DataFrame:
    """(id, decoded binary), or with digest the count and hashes of ids and of the decoded bytes.

    A null list counts as empty. Each row, also one without an id or with another's, has its own result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = load(path, pattern)
        for b in bounded(batches):
            rows = []
            for ids in b.column(1):
                ids = ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else []
                raw = bpe.decode(ids)
                rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()) if digest else (raw,))
            cols = [list(c) for c in zip(*rows)] or [[]] * (3 if digest else 1)
            kinds = (pa.int64(), pa.string(), pa.string()) if digest else (pa.binary(),)
            names = ("n_tokens", "ids_sha256", "decoded_sha256") if digest else ("decoded",)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["id", *names])

    schema = "id long, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "decoded binary")
    return df.select(df[id_col].cast("long").alias("id"), ids_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
