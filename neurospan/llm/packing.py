"""Best-fit packing of documents into sequences by a linear grouping scheme over lengths.

Only a histogram of lengths (no longer than the capacity) comes to the driver. There large lengths are
rounded up to the largest of their group, groups being of equal cardinality as far as ties allow. Over
these few sizes configurations and how often each is used are optimised as a linear program, by column
generation; whole multiples are kept and the rest is completed greedily. Then the actual lengths are
substituted for the sizes, and small lengths are placed by best fit into the room that is left. The plan
is a list of runs of like sequences, its size bounded by the capacity and the number of groups.
Documents take the slots of their length by rank, ranks being counted within hash buckets of each
length, so that no length meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, materialize
from .planes import hf_ids

GROUPS = 128  # sizes that configurations are made of, at most
ROUNDS = 600  # of column generation, at most
SMALL = (3, 16)  # lengths below capacity / SMALL are small; the plan of fewest sequences is taken
BUCKET_ROWS = 50_000  # rows of a class are ranked in buckets of about so many at most


@dataclass
class Run:
    """`count` sequences from `first` on, each with the same items (size, copies)."""

    first: int
    count: int
    items: tuple[tuple[int, int], ...]
    room: int


@dataclass
class Plan:
    slots: dict[int, np.ndarray]  # length to rows (first rank, first sequence, copies, first place)
    sequences: int


def grouped(counts: np.ndarray, groups: int) -> np.ndarray:
    """size_of[length]: the largest length of its group."""
    size_of, have = np.arange(len(counts)), np.flatnonzero(counts)
    if len(have) > groups:
        target, held, start = counts.sum() / groups, 0, 0
        for k, n in enumerate(have):
            held += counts[n]
            if held >= target or k == len(have) - 1:
                size_of[have[start : k + 1]] = n
                held, start = 0, k + 1
    return size_of


def _completion(left: np.ndarray, room: int) -> list[int]:
    """One or two sizes of those left that fill most of the room."""
    have = left[: room + 1] > 0
    top = int(np.flatnonzero(have)[-1]) if have.any() else 0
    for total in range(room, top, -1):
        both = have[: total + 1] & have[: total + 1][::-1]
        if total % 2 == 0 and both[total // 2] and left[total // 2] < 2:
            both[total // 2] = False
        if both.any():
            x = int(np.flatnonzero(both)[-1])
            return [x, total - x]
    return [top] if top else []


def configurations(counts: np.ndarray, capacity: int) -> list[Run]:
    """Runs that hold all sizes: the largest left, completed by sizes that fill the room best, as often as they last."""
    left, runs, at = counts.astype(np.int64).copy(), [], 0
    largest = len(left) - 1
    while True:
        while largest > 0 and not left[largest]:
            largest -= 1
        if largest <= 0:
            return runs
        items = {largest: 1}
        room = capacity - largest
        left[largest] -= 1
        while room > 0 and (more := _completion(left, room)):
            for s in more:
                items[s] = items.get(s, 0) + 1
                left[s] -= 1
                room -= s
        for s, c in items.items():
            left[s] += c
        times = min(int(left[s]) // c for s, c in items.items())
        for s, c in items.items():
            left[s] -= c * times
        runs.append(Run(at, times, tuple(items.items()), room))
        at += times


def _best_configuration(sizes: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each size that fit together and are worth most at these prices."""
    value, steps = np.zeros(capacity + 1), []
    for s, p in zip(sizes.tolist(), price.tolist()):
        steps.append(value)
        if p > 0:
            best = value.copy()
            for k in range(1, capacity // s + 1):
                np.maximum(best[k * s :], value[: capacity + 1 - k * s] + k * p, out=best[k * s :])
            value = best
    copies, w = np.zeros(len(sizes)), capacity
    for i in range(len(sizes) - 1, -1, -1):
        s, p, before = int(sizes[i]), float(price[i]), steps[i]
        if value[w] > before[w] + 1e-12:
            k = np.arange(w // s + 1)
            copies[i] = n = int(np.argmax(before[w - k * s] + k * p))
            w -= n * s
        value = before
    return copies


def optimised(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[int, dict[int, int]]]:
    """(times, configuration): the whole parts of a least fractional cover of counts by configurations.

    Simplex steps from the greedy cover on, in which each configuration uses up a size; the next one to
    enter is the best at the prices of the sizes, found by dynamic programming over the capacity.
    """
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return []
    basis, x = np.zeros((len(sizes), len(sizes))), np.zeros(len(sizes))
    left, place = counts.astype(float), {int(s): i for i, s in enumerate(sizes)}
    for largest in sizes[::-1].tolist():
        while left[largest] > 0:
            items = {largest: 1}
            room = capacity - largest
            while room > 0 and (more := _completion(left, room)):
                for s in more:
                    items[s] = items.get(s, 0) + 1
                    room -= s
            used = min(items, key=lambda s: left[s] / items[s])
            times = left[used] / items[used]
            for s, c in items.items():
                left[s] = max(0.0, left[s] - c * times)
            left[used] = 0
            x[place[used]] = times
            for s, c in items.items():
                basis[place[s], place[used]] = c
    for j in np.flatnonzero(basis.sum(axis=0) == 0):  # sizes used up together with others
        basis[j, j] = 1
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(len(sizes)))
        enter = _best_configuration(sizes, price, capacity)
        if price @ enter < 1 + 1e-6:
            break
        change = np.linalg.solve(basis, enter)
        able = np.flatnonzero(change > 1e-9)
        ratio = x[able] / change[able]
        leave, step = able[np.argmin(ratio)], ratio.min()
        x = np.maximum(x - step * change, 0)
        x[leave], basis[:, leave] = step, enter
    times = np.floor(x + 1e-6).astype(np.int64)
    return [(int(n), {int(s): int(c) for s, c in zip(sizes, basis[:, j]) if c}) for j, n in enumerate(times) if n]


def substituted(runs: list[Run], counts: np.ndarray, size_of: np.ndarray, capacity: int) -> list[Run]:
    """Runs with actual lengths in place of sizes, the largest of each first, and the room that these leave."""
    queue: dict[int, list[list[int]]] = {}
    for n in np.flatnonzero(counts):
        queue.setdefault(int(size_of[n]), []).append([int(n), int(counts[n])])
    out = []
    for r in runs:
        first, count = r.first, r.count
        while count:
            # as many sequences as the first lengths of all sizes last; or one of several lengths of a size
            whole = min(queue[s][-1][1] // c for s, c in r.items)
            times, items = min(count, max(1, whole)), {}
            for s, c in r.items:
                need = c * times
                while need:
                    n, left = queue[s][-1]
                    took = min(need, left)
                    if whole:
                        items[n] = items.get(n, 0) + c
                    else:
                        items[n] = items.get(n, 0) + took
                    queue[s][-1][1] -= took
                    if not queue[s][-1][1]:
                        queue[s].pop()
                    need -= took
            out.append(Run(first, times, tuple(items.items()), capacity - sum(n * c for n, c in items.items())))
            first, count = first + times, count - times
    return out


def best_fit(runs: list[Run], counts: np.ndarray, capacity: int) -> list[Run]:
    """Places small sizes, largest first, each into the least room that takes it."""
    rooms: list[list[Run]] = [[] for _ in range(capacity + 1)]
    at = 0
    for r in runs:
        rooms[r.room].append(r)
        at += r.count
    for s in range(len(counts) - 1, 0, -1):
        n = int(counts[s])
        for v in range(s, capacity + 1):
            if not n:
                break
            q, kept = v // s, []
            for r in rooms[v]:
                full = min(r.count, n // q)
                if full:
                    rooms[v - q * s].append(Run(r.first, full, (*r.items, (s, q)), v - q * s))
                    n -= full * q
                rest = Run(r.first + full, r.count - full, r.items, v)
                if rest.count and n:
                    rooms[v - n * s].append(Run(rest.first, 1, (*r.items, (s, n)), v - n * s))
                    rest, n = Run(rest.first + 1, rest.count - 1, r.items, v), 0
                if rest.count:
                    kept.append(rest)
            rooms[v] = kept
        if n:
            q = capacity // s
            if n // q:
                rooms[capacity - q * s].append(Run(at, n // q, ((s, q),), capacity - q * s))
                at += n // q
            if n % q:
                rooms[capacity - n % q * s].append(Run(at, 1, ((s, n % q),), capacity - n % q * s))
                at += 1
    return [r for own in rooms for r in own]


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> Plan:
    """Lengths (1 to the capacity) with their counts to places in sequences; the same histogram always has the same plan."""
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        if not 0 < n <= capacity:
            raise ValueError(f"length {n} isn't in 1..{capacity}")
        counts[n] = c
    return min((_plan(counts, capacity, groups, max(1, capacity // s)) for s in SMALL), key=lambda p: p.sequences)


def _plan(counts: np.ndarray, capacity: int, groups: int, cut: int) -> Plan:
    large, small = counts.copy(), counts.copy()
    large[:cut], small[cut:] = 0, 0
    size_of = grouped(large, groups)
    sizes = np.bincount(size_of, weights=large, minlength=capacity + 1).astype(np.int64)
    runs, at = [], 0
    for times, items in optimised(sizes, capacity):
        runs.append(Run(at, times, tuple(items.items()), 0))
        at += times
        for s, c in items.items():
            sizes[s] -= c * times
    runs += [Run(at + r.first, r.count, r.items, r.room) for r in configurations(sizes, capacity)]
    runs = best_fit(substituted(runs, large, size_of, capacity), small, capacity)
    slots: dict[int, list] = {}
    held: dict[int, int] = {}
    for r in sorted(runs, key=lambda r: r.first):
        place = 0
        for s, c in r.items:
            slots.setdefault(s, []).append((held.get(s, 0), r.first, c, place))
            held[s] = held.get(s, 0) + r.count * c
            place += c
    return Plan({s: np.array(x, np.int64) for s, x in slots.items()}, sum(r.count for r in runs))


def token_pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids binary]) of whole texts; a text beyond the capacity is cut, its first piece taking what is over.

    A null text is empty and has the end id alone. Each row, also one without an id or with another's, has pieces of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for b in bounded(batches):
            rows = []
            coded = hf_ids(b.column(1), tokenizer)
            for i, raw in zip(b.column(0).to_pylist(), coded):
                raw += end
                n = len(raw) // 4
                a, k = 0, 0
                z = n % capacity or capacity
                while a < n:
                    part = raw[4 * a : 4 * z]
                    rows.append((i, k, a, z - a, zlib.crc32(part), part)[: 6 if keep_ids else 5])
                    a, z, k = z, z + capacity, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("id", "piece", "start", "length", "ids_crc32", "ids")
            cols = [list(c) for c in zip(*rows)] or [[]] * (6 if keep_ids else 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=list(names[: len(cols)]))

    schema = "id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return df.select(df[id_col].cast("long").alias("id"), df[text_col]).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def pack(pieces: DataFrame, capacity: int, order: list[str], groups: int = GROUPS) -> DataFrame:
    """Adds sequence_id and offset to written pieces (they are read three times). order: columns that tell pieces apart.

    Rows that agree in all of these are alike, and may change places. An empty table stays empty.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made = plan(histogram, capacity, groups)
    held = spark.sparkContext.broadcast(made.slots)
    buckets = max(16, sum(histogram.values()) // BUCKET_ROWS)

    keyed = pieces.withColumn("_class", F.col("length").cast("int")).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    per = keyed.groupBy("_class", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("_class", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_class", "_bucket").orderBy(*order)
    ranked = keyed.withColumn("_rank", F.row_number().over(own) - 1).join(base, ["_class", "_bucket"])

    @F.pandas_udf("sequence_id long, place int")
    def slot(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        slots = held.value
        seq, place = np.zeros(len(size), np.int64), np.zeros(len(size), np.int32)
        sizes, ranks = size.to_numpy(), rank.to_numpy()
        for s in np.unique(sizes).tolist():
            at, table = np.flatnonzero(sizes == s), slots[s]
            k = np.searchsorted(table[:, 0], ranks[at], side="right") - 1
            past = ranks[at] - table[k, 0]
            seq[at], place[at] = table[k, 1] + past // table[k, 2], table[k, 3] + past % table[k, 2]
        return pd.DataFrame({"sequence_id": seq, "place": place})

    put = ranked.withColumn("_slot", slot("_class", F.col("_rank") + F.col("_base")))
    put = put.select(*pieces.columns, "_slot.sequence_id", F.col("_slot.place").alias("_place"))
    ahead = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return put.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("_place")


def pack_documents(df: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id") -> DataFrame:
    pieces = materialize(token_pieces(df, tokenizer, end_id, capacity, id_col), even=True)
    return pack(pieces, capacity, [id_col, "piece", "start", "ids_crc32"])
