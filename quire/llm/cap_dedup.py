"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A filter is a random direction; a vector passes if its cosine with it reaches a height. Close vectors pass the same filters.
Directions are products: the space, turned at random, is cut into blocks with a random code each, and a filter takes one code
word of each block. So the filters that a vector passes can be listed (list decoding) by branch and bound over the blocks'
sorted scores, without trying all. Several codes, each turned otherwise, leave hardly a vector without filters. Vectors are joined on (label, filter) and verified by their cosine in double precision.

The number of filters follows the number of vectors, so that buckets keep their size. Buckets that are large all the same
(many near copies) are cut into blocks and compared block against block. A pair counts in the first filter that both pass. Pairs
are never rows: a block sums up each vector's links and gives a spanning forest. Equal vectors are one class from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C

#: Codes, each with a turn of its own; filters of a code that a vector passes on average; vectors that share a filter by chance; rows of a block.
#: The README has the recall simulated with these.
CODES, PASSED, CHANCE, BLOCK = 8, 4, 1, 2048


@dataclass(frozen=True)
class ProductCode:
    """blocks codes of words code words each for vectors of dim components; filters = words ** blocks."""

    dim: int
    blocks: int
    words: int
    passed: int = PASSED
    seed: int = 0

    @classmethod
    def of(cls, dim: int, vectors: int, passed: int, seed: int) -> ProductCode:
        """Enough filters for chance to put CHANCE vectors in one. Two blocks at any size: with three, vectors are left without filters."""
        filters = max(4 * passed, vectors * passed // CHANCE)
        blocks = max(1, min(dim // 2, 2))
        return cls(dim, blocks, max(2, math.ceil(filters ** (1 / blocks))), passed, seed)

    @cached_property
    def height(self) -> float:
        """The cosine at which random vectors pass as many filters as asked for on average, found on random directions by bisection."""
        x = np.random.default_rng(self.seed).standard_normal((200, self.dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        low, high = 0.0, 1.0
        usual = NormalDist().inv_cdf(1 - min(0.5, self.passed / self.words**self.blocks)) / math.sqrt(self.dim)
        low = 0.6 * usual
        for _ in range(12):
            mid = (low + high) / 2
            low, high = (mid, high) if len(self._decode(x, mid)[0]) > self.passed * len(x) else (low, mid)
        return high

    @cached_property
    def codes(self) -> tuple[np.ndarray, list[np.ndarray]]:
        rng = np.random.default_rng((self.seed, self.dim, self.blocks, self.words))
        turn = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
        words = []
        for cols in np.array_split(np.arange(self.dim), self.blocks):
            c = rng.standard_normal((self.words, len(cols)))
            words.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(self.blocks))
        return turn, words

    def passed_by(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Of each unit vector the sorted numbers of all filters that it passes."""
        step = max(1, (1 << 20) // self.words)
        out = []
        for at in range(0, len(vectors), step):
            part = vectors[at : at + step]
            v, f = self._decode(part, self.height)
            order = np.lexsort((f, v))
            out += np.split(f[order], np.cumsum(np.bincount(v, minlength=len(part)))[:-1])
        return out

    def _decode(self, vectors: np.ndarray, height: float) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter) of all that reach the height. Of each block only the words that reach it with the best of the other are paired."""
        turn, codes = self.codes
        turned = vectors @ turn
        parts = np.array_split(np.arange(self.dim), self.blocks)
        scores = [turned[:, cols] @ c.T for cols, c in zip(parts, codes)]
        if self.blocks == 1:
            return np.nonzero(scores[0] >= height)
        s, t = scores
        (v, a), (w, b) = (np.nonzero(x >= height - y.max(axis=1, keepdims=True) - 1e-9) for x, y in ((s, t), (t, s)))
        count = np.bincount(w, minlength=len(vectors))
        first = np.cumsum(count) - count
        k = np.repeat(np.arange(len(v)), count[v])
        j = first[v[k]] + np.arange(len(k)) - np.repeat(np.cumsum(count[v]) - count[v], count[v])
        hit = s[v[k], a[k]] + t[v[k], b[j]] >= height
        return v[k][hit], (a[k] * self.words + b[j])[hit]


@lru_cache(maxsize=64)
def product_codes(dim: int, vectors: int, passed: int, n_codes: int) -> tuple[ProductCode, ...]:
    """A worker makes the codes for vectors of one length once."""
    return tuple(ProductCode.of(dim, vectors, passed, i) for i in range(n_codes))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, however large or small their components are."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _block_links(x: np.ndarray, ids: np.ndarray, copies: np.ndarray, side: np.ndarray, two: bool, earlier: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, links and roots of the linked unit vectors of one block. two: only pairs of different sides count. earlier: filters before this one."""
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    if two:
        near &= side[:, None] != side[None, :]
    if near.any():
        some = np.flatnonzero(near.any(1))
        filters, at = np.unique(np.concatenate([earlier[i] for i in some]), return_inverse=True)
        if len(filters):
            has = np.zeros((len(some), len(filters)), np.float32)
            has[np.repeat(np.arange(len(some)), [len(earlier[i]) for i in some]), at] = 1
            near[np.ix_(some, some)] &= has @ has.T == 0
    some = np.flatnonzero(near.any(1))
    near = near[np.ix_(some, some)]
    root = ids[some].copy()
    while len(some):
        low = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(1))
        if (low == root).all():
            break
        root = low
    return ids[some], near @ copies[some], root


def link_vectors(vectors: DataFrame, least: float = 0.98, n_codes: int = CODES, passed: int = PASSED, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors(vec_id, embedding, label); other columns are not read.

    Vectors of equal, non-null labels (and equal length, of which there may be any number) link if their cosine in double precision is
    `least` or more; components of float or double are taken as they are. Vectors that are null, empty, zero, or hold null or non-finite
    components, and rows without a label or vec_id, link with nothing. Rows with one vec_id are vectors each with links of their own (a
    second row counts as another vector), but one node of the components. An empty table gives no rows.
    """
    kind = "double" if vectors.schema["embedding"].dataType.elementType.typeName() == "double" else "float"
    form = {"double": "<f8", "float": "<f4"}[kind]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("e"), F.col("label").cast("string").alias("label"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & finite & F.exists("e", lambda x: x != 0)
    keyed = C.cut(rows.select("vec_id", "label", "e", F.when(F.coalesce(valid, F.lit(False)), F.xxhash64("label", "e")).alias("k1"), F.xxhash64("e", "label").alias("k2")))
    # equal vectors of a label are a class; k1 is its name
    classes = C.cut(keyed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("e").alias("e")))
    sizes = C.small_side(C.cut(classes.groupBy(F.size("e").alias("dim")).agg(F.count("*").alias("n"))))  # a row for each length
    sized = classes.withColumn("dim", F.size("e")).join(sizes, "dim")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                label, e, n = batch.column(1).to_pylist(), batch.column(2), batch.column(4).to_numpy()
                offsets, flat = e.offsets.to_numpy(), e.values.to_numpy()
                long = np.diff(offsets)
                filters: list = [None] * len(long)
                for dim in np.unique(long):
                    at = np.flatnonzero(long == dim)
                    x = unit(flat[offsets[at][:, None] + np.arange(dim)])
                    own = product_codes(int(dim), int(n[at[0]]), passed, n_codes)
                    each = [c.passed_by(x) for c in own]
                    for k, i in enumerate(at):
                        filters[i] = np.concatenate([f[k] + c * own[0].words ** own[0].blocks for c, f in enumerate(each)])
                v = [flat[a:b].astype(form).tobytes() for a, b in zip(offsets, offsets[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"{d}|{x}" for d, x in zip(long, label)]), batch.column(3), pa.array(v, pa.binary()), pa.array(filters, pa.list_(pa.int64()))], ["k1", "label", "copies", "v", "filters"])

    decoded = C.cut(sized.select("k1", "label", "e", "copies", "n").mapInArrow(decode, "k1 long, label string, copies long, v binary, filters array<long>"))
    # buckets by narrow rows first: vectors move only to buckets with two or more, to large ones in blocks
    passing = decoded.select("k1", "label", F.explode("filters").alias("filter"))
    full = passing.groupBy("label", "filter").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block))
    joined = passing.join(full, ["label", "filter"]).withColumn("side", F.pmod(F.xxhash64("k1"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    spread = joined.withColumn("o", other).withColumn("i", F.least("side", "o")).withColumn("j", F.greatest("side", "o"))
    spread = spread.select("k1", "label", "filter", "i", "j", "side").join(decoded.select("k1", "copies", "v", "filters"), "k1")
    spread = spread.withColumn("earlier", F.filter("filters", lambda f: f < F.col("filter")))
    keys = ["label", "filter", "i", "j"]
    spread = spread.select(*keys, "side", "k1", "copies", "v", "earlier").repartition(*keys).sortWithinPartitions(*keys, "k1", "copies")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in C.groups(batches, len(keys)):
            if group.num_rows < 2:
                continue
            side, ids, copies = (group.column(c).to_numpy() for c in ("side", "k1", "copies"))
            x = unit(np.array([np.frombuffer(v, form) for v in group.column("v").to_pylist()]))
            earlier = [np.array(f, np.int64) for f in group.column("earlier").to_pylist()]
            two = group.column("i")[0] != group.column("j")[0]
            a, n, root = _block_links(x, ids, copies, side, two, earlier, least)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n), pa.array(root)], ["a", "links", "b"])

    found = C.cut(spread.mapInArrow(compare, "a long, links long, b long"))
    links = found.groupBy(F.col("a").alias("k1")).agg(F.sum("links").alias("links"))
    # rows that share a vec_id join their classes
    same = keyed.where("k1 is not null").groupBy("vec_id").agg(F.min("k1").alias("b"), F.max("k1").alias("hi")).where("b < hi").select("vec_id", "b")
    same = keyed.where("k1 is not null").join(same, "vec_id").where("k1 != b").select(F.col("k1").alias("a"), "b")
    roots = C.cut(C.components(found.select("a", "b").unionByName(same)).withColumnRenamed("id", "k1"))
    least_id = classes.join(roots, "k1").groupBy("root").agg(F.min("rep").alias("c"))
    whole = classes.select("k1", "k2", "rep", "copies").join(links, "k1", "left").join(roots.join(least_id, "root").select("k1", "c"), "k1", "left")
    whole = whole.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("c", "rep").alias("c"))
    out = keyed.select("vec_id", "k1", "k2").join(whole, ["k1", "k2"], "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
