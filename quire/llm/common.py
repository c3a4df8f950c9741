"""What several operators share: cut lineage, connected components, checked broadcasts, vectorised word hashing."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow side (ids or 64-bit keys) is broadcast, about 20 MB; beyond it the join shuffles.
BROADCAST_ROWS = 400_000


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder from spark.checkpoint.dir; a folder of our own only in local mode, where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quire-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder and read it from there: lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows that it has at most so many rows; otherwise as it is. df must be cut."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b): (id, root) for each id in an edge, root the smallest id reachable.

    Alternates large-star and small-star steps. Each step is a partial minimum for each node and a join, so a hub
    with very many neighbours is reduced before the shuffle and split by the skew join. Logarithmic in the diameter.
    """
    state = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state, before = cut(state), None
    for _ in range(most_rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("s"))
        state = cut(small.select(F.col("s.u").alias("u"), F.col("s.m").alias("v")).where("u != v").distinct())
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = state.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")
    return nodes.unionByName(nodes.select(F.col("root").alias("id"), "root").distinct())


def packed(docs: DataFrame, *extra: Column) -> DataFrame:
    """docs as one struct column "row", with further columns: no name of docs can clash with these."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), *extra)


def own(name: str) -> Column:
    """A column of docs in packed(docs)."""
    return F.col(f"row.`{name}`")


def unpacked(rows: DataFrame, docs: DataFrame, text: Column | None = None, made: dict[str, Column] | None = None) -> DataFrame:
    """The columns of docs again, with another text (n_chars, where there is such a column, follows it), then the made columns.

    A made column whose name docs has is named name_1, name_2 and so on: the first that is free.
    """
    out = []
    for c in docs.columns:
        value = own(c)
        if text is not None and c == "text":
            value = text
        elif text is not None and c == "n_chars":
            value = F.length(text).cast(docs.schema[c].dataType)
        out.append(value.alias(c))
    taken = {c.lower() for c in docs.columns}
    for name, value in (made or {}).items():
        k, free = 0, name
        while free.lower() in taken:
            k += 1
            free = f"{name}_{k}"
        taken.add(free.lower())
        out.append(value.alias(free))
    return rows.select(*out)


#: Of the hashes below; any fixed odd numbers and seed do.
_STEP, _SEED = 0x9E3779B97F4A7C15, 20240229
_TABLE = np.random.default_rng(_SEED).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 1 << 20)
            for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


POWERS = Powers()


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i], times the step to the power -i, a hash of bytes i to j."""
    up, _ = POWERS.to(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * up[: len(buf)], out=out[1:])
    return out


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than 0x20 and 0x09 to 0x0D."""
    word = np.zeros(len(buf) + 2, np.int8)
    word[1:-1] = ~SPACE[buf]
    turn = np.diff(word)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def slices(sizes: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most so many bytes together; a larger item has a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first columns, of sorted batches; runs are at most two blocks long."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        change = np.zeros(max(table.num_rows - 1, 0), bool)
        for i in range(n_keys):
            c = table.column(i).combine_chunks()
            codes = c.dictionary_encode().indices.to_numpy() if pa.types.is_string(c.type) else c.to_numpy()
            change |= codes[1:] != codes[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield table.slice(a, b - a)
        held = table.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held
