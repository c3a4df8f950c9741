"""Packing documents into sequences of fixed length: a configuration linear program over the histogram of lengths.

A configuration says how many pieces of each length one sequence holds. The program asks for the fewest sequences, as
non-negative amounts of configurations, that hold every piece of the histogram. Multiplicative weights solve it: each length
has a price; the oracle prices configurations by an unbounded knapsack (dynamic programming over the capacity) and returns the
dearest; lengths that it covers get cheaper. The average of the configurations, scaled until all is covered, is near the optimum.
Rounded down, it gives whole amounts; what is left goes by best fit decreasing, as pieces of the histogram too.

Nothing here grows with the number of documents but the tables themselves: the histogram has `capacity` rows, the plan some
thousand configurations. Each piece finds its place from its rank among the pieces of its length; ranks come from counts by
(length, bucket), so that a length which a third of all pieces share is dealt over the buckets.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C
from quire.llm.bpe import PIECES, load

CAPACITY, ROUNDS, BUCKETS = 2048, 300, 256


@lru_cache(maxsize=2)
def fast_encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of a tokenizers file for tiktoken, which gives the same ids several times as fast."""
    bpe = load(path)
    special = {s: i for s, i in bpe.special.items()}
    ranks = {b: i for i, b in bpe.bytes_of.items() if i not in special.values()}
    by_rank = sorted((r, i) for r, i in bpe.rank.values())
    if [i for _, i in by_rank] != sorted(i for _, i in by_rank) or bpe.nfc:
        raise ValueError("ids do not follow the merge ranks")
    return tiktoken.Encoding("fast", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)


def dearest(price: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, Counter]:
    """Unbounded knapsack: the configuration of at most capacity with the largest sum of prices."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for s in range(int(lengths[0]), capacity + 1):
        m = upto[s]
        value = price[:m] + best[s - lengths[:m]]
        i = int(value.argmax())
        if value[i] > best[s - 1]:
            best[s], took[s] = value[i], i
        else:
            best[s] = best[s - 1]
    config, s = Counter(), capacity
    while s > 0:
        if took[s] < 0:
            s -= 1
        else:
            config[int(lengths[took[s]])] += 1
            s -= int(lengths[took[s]])
    return float(best[capacity]), config


def linear_program(counts: dict[int, int], capacity: int, rounds: int = ROUNDS) -> list[tuple[Counter, float]]:
    """Configurations and amounts that hold all pieces, nearly as few as can be."""
    lengths = np.array(sorted(counts))
    want = np.array([counts[x] for x in lengths], float)
    # a first solution prices lengths by their share of a sequence
    price, total, amounts = lengths / capacity, np.zeros(len(lengths)), Counter()
    kept: dict[tuple, Counter] = {}
    for r in range(rounds):
        _, config = dearest(price, lengths, capacity)
        covers = np.array([config.get(int(x), 0) for x in lengths], float)
        used = covers > 0
        step = float((want[used] / covers[used]).min())  # no length is covered beyond its count by one step
        key = tuple(sorted(config.items()))
        kept[key] = config
        amounts[key] += step
        total += step * covers
        gain = step * covers / want
        price = price * np.exp(-0.7 * gain) if r % 50 else lengths / capacity * np.exp(-0.7 * total / want)
        price /= price.max()
        price = np.maximum(price, 1e-9)
    scale = 1 / max((total / want).min(), 1e-12) if (total > 0).all() else 1 / max(float(np.median(total / want)), 1.0)
    return [(kept[k], a * scale) for k, a in amounts.items()]


def plan(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[Counter, int]]:
    """Whole amounts of configurations that hold exactly the pieces of the histogram."""
    left, out = Counter({int(x): int(n) for x, n in counts.items() if n}), []
    while left:
        before = sum(left.values())
        for config, amount in sorted(linear_program(left, capacity, rounds), key=lambda x: -x[1]):
            times = min(int(amount + 1e-9), *(left[x] // n for x, n in config.items()))
            if times > 0:
                out.append((config, times))
                for x, n in config.items():
                    left[x] -= n * times
        left = +left
        if before - sum(left.values()) < 0.2 * before:
            break
    # best fit decreasing, equal pieces and equal bins together
    open_bins: list[list] = []  # room, config, how many
    for x in sorted(left, reverse=True):
        n = left[x]
        while n:
            fits = [b for b in open_bins if b[0] >= x]
            if not fits:
                per = capacity // x
                if n >= per:
                    open_bins.append([capacity - per * x, Counter({x: per}), n // per])
                    n %= per
                if n:
                    open_bins.append([capacity - n * x, Counter({x: n}), 1])
                n = 0
                continue
            best = min(fits, key=lambda b: b[0])
            per = best[0] // x
            if n < per * best[2]:
                if n < per:  # one of these bins takes what is left
                    whole, rest = 1, n
                else:
                    whole, rest = n // per, per
                if best[2] > whole:
                    open_bins.append([best[0], Counter(best[1]), best[2] - whole])
                    best[2] = whole
                per = rest
            best[0] -= per * x
            best[1][x] += per
            n -= per * best[2]
    return out + [(c, k) for _, c, k in open_bins]


def slots(made: list[tuple[Counter, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank of each run of places, first sequence, places a sequence, offset of the first."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for config, times in made:
        at = 0
        for x in sorted(config, reverse=True):
            runs.setdefault(x, []).append((config[x] * times, first, config[x], at))
            at += x * config[x]
        first += times
    out = {}
    for x, r in runs.items():
        n = np.array([y[0] for y in r], np.int64)
        out[x] = (np.cumsum(n) - n, *(np.array([y[i] for y in r], np.int64) for i in (1, 2, 3)))
    return out


def encode(path: str, text: str, enc: tiktoken.Encoding, special: set[str]) -> list[int]:
    """Ids of a text. Long runs of blanks are more than the fast encoder's pattern can take; these texts go through our own."""
    try:
        return enc.encode(text, allowed_special=special, disallowed_special=())
    except ValueError:
        return load(path).encode(text)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and end_id; only what is longer than capacity is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = fast_encoding(path)
        special = enc.special_tokens_set
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(path, text.as_py() or "", enc, special), end_id], "<u4")
                first = len(ids) % capacity or capacity
                for k, (a, b) in enumerate(zip([0, *range(first, len(ids), capacity)], range(first, len(ids) + 1, capacity))):
                    for column, x in zip(rows, (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, rounds: int = ROUNDS, buckets: int = BUCKETS) -> DataFrame:
    """Each piece of docs(doc_id, text) with its place: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null or empty text is a piece of end_id alone; a text of any length is cut into pieces, none is left out. Rows that share a doc_id, or
    whose doc_id is null, are packed each. Other columns are not read. An empty table gives no rows.
    """
    cut = C.cut(pieces(docs, path, capacity, end_id).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")))
    counts = cut.groupBy("length", "bucket").count().collect()  # at most capacity * buckets rows
    table = np.zeros((capacity + 1, buckets), np.int64)
    for length, bucket, n in counts:
        table[length, bucket] = n
    histogram = {x: int(n) for x, n in enumerate(table.sum(1)) if n}
    if not histogram:
        return cut.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    places = slots(plan(histogram, capacity, rounds))
    base = np.cumsum(table, axis=1) - table
    narrow = "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # all pieces of a length and bucket are in one partition, so a counter for each (length, bucket) gives ranks
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            length, bucket = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            key = length * buckets + bucket
            order = np.argsort(key, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else ():
                x, b = int(length[rows[0]]), int(bucket[rows[0]])
                done = seen.setdefault(b, np.zeros(capacity + 1, np.int64))
                rank = base[x, b] + done[x] + np.arange(len(rows))
                done[x] += len(rows)
                first, sequence, per, at = places[x]
                i = np.searchsorted(first, rank, side="right") - 1
                q = rank - first[i]
                seq[rows], off[rows] = sequence[i] + q // per[i], at[i] + q % per[i] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # sorted, so that a task that runs again gives each row the same place
    dealt = cut.selectExpr(*(x.rsplit(" ", 1)[0] for x in narrow.split(", "))).repartition("length", "bucket").sortWithinPartitions("length", "bucket", "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
