"""Jaccard self-join on word n-grams: T-occurrence search in the manner of DivideSkip, spread over a cluster.

Two sets of n and m shingles with Jaccard similarity at least t share T = ceil(t / (1 + t) * (n + m)) of them, and
T >= ceil(t * n). Of the n inverted lists that a document asks for, the T - 1 longest are set aside (the "long" lists);
a partner must then occur in one of the n - T + 1 short ones at least. The short lists are merged by token (the shuffle's
sort-merge takes the heap's place); what they give is probed in the long ones by binary search.

1. Equal sets become one class; only classes go on.
2. Let p = n - ceil(t n) + 1. Of the p + e lowest hashes of each document, linked ones share e + 1. So documents with fewer
   tokens there that any other has link with nothing. A boilerplate passage in a longer document does not get it past this.
3. Lists of at most `long_list` documents are short, the rest long. A document with L long lists among its lowest hashes has
   with any partner at least e + 1 - L short lists in common; merging the short ones and counting gives the candidates.
4. If L > e, partners may share long lists only. Among such documents, tokens are ordered by (long or not, hash), so that those
   with p rare tokens of their own enter no long list; what still meets in a list is first held against leaders of the list.
5. Candidates are probed: the tokens of one in the sorted tokens of the other. First each against one partner or leader (a
   star, not all pairs); what that links is one component, and then the pairs between different components. In a long
   list these are found block against block, by counting what they share of their first p + e tokens, of which linked ones
   share e + 1, in the list of the lowest token that a pair shares, and probed there: only links that join components of the
   block become rows, fewer than it has documents.

No pair is dropped or capped: step 5 leaves out pairs only where both are known to be connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C

#: Leaders of each list; lists up to this length give pairs at once; documents of a block of a longer one.
STARS, LONG_LIST, BLOCK = 3, 32, 512
#: Tokens of one document's partners that are probed at once.
PROBED = 1 << 20
_FACTORS = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its k-word shingles, A-Z lower-cased.

    Fewer than k words are one shingle; no word, no text: none.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in texts]
    out: list[np.ndarray] = []
    none = np.zeros(0, np.int64)
    for lo, hi in C.slices([len(x) for x in raw]):
        part = raw[lo:hi]
        buf = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        ends = np.cumsum([len(x) + 1 for x in part])
        a, b = C.word_spans(buf)
        h, (_, down) = C.prefix_hash(buf), C.POWERS.to(len(buf) + 1)
        words = C.mix((h[b] - h[a]) * down[a])
        cuts = np.concatenate(([0], np.searchsorted(a, ends)))
        full = max(len(words) - k + 1, 0)
        sums = np.zeros(full, np.uint64)
        for j in range(k):
            sums += words[j : j + full] * _FACTORS[j]
        sums = C.mix(sums)
        for i, j in zip(cuts[:-1], cuts[1:]):
            if j - i >= k:
                out.append(np.unique(sums[i : j - k + 1].view(np.int64)))
            elif j > i:
                short = (words[i:j] * _FACTORS[: j - i]).sum(dtype=np.uint64) + np.uint64(j - i)
                out.append(C.mix(np.array([short], np.uint64)).view(np.int64))
            else:
                out.append(none)
    return out


def needed(n: int, t: float) -> int:
    """ceil(t * n), exact for t given to four decimals."""
    return -(-n * round(t * 10_000) // 10_000)


def low_count(n: int, t: float) -> tuple[int, int]:
    """How many of the lowest hashes step 2 looks at, and how many of them must occur elsewhere."""
    p = n - needed(n, t) + 1
    e = min(n - p, p // 4 + 2)
    return p + e, e + 1


def _sets(docs: DataFrame, k: int, emit: str, t: float) -> DataFrame:
    """emit: "key" (doc_id, n, h1, h2), "low" (doc_id, need, low) or "set" (doc_id, tokens); rows without an id or shingles only in "key"."""
    schema = {"key": "doc_id long, n long, h1 long, h2 long", "low": "doc_id long, need int, low array<long>", "set": "doc_id long, tokens array<long>"}[emit]

    def lists(x: list[np.ndarray]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(y) for y in x]))), pa.int32()), pa.array(np.concatenate([*x, np.zeros(0, np.int64)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids, sets = batch.column(0), shingle_hashes(batch.column(1).to_pylist(), k)
                if emit == "key":
                    h = [[int(C.mix(s.view(np.uint64) + np.uint64(x)).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for x in (11, 12345)]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(h[0], pa.int64()), pa.array(h[1], pa.int64())], ["doc_id", "n", "h1", "h2"])
                    continue
                keep = np.array([len(s) > 0 for s in sets]) & ids.is_valid().to_numpy(zero_copy_only=False)
                ids, sets = ids.filter(pa.array(keep)), [s for s, x in zip(sets, keep) if x]
                if emit == "low":
                    size = [low_count(len(s), t) for s in sets]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in size], pa.int32()), lists([s[: x[0]] for s, x in zip(sets, size)])], ["doc_id", "need", "low"])
                else:
                    yield pa.RecordBatch.from_arrays([ids, lists(sets)], ["doc_id", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _probe(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the overlap: b's tokens are probed in a's sorted ones by binary search."""
    of = lambda x: sets.select(F.col("doc_id").alias(x), F.col("tokens").alias(f"t{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            (va, oa), (vb, ob) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(2), batch.column(3)))
            for i in range(batch.num_rows):
                x, y = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                if len(x) < len(y):
                    x, y = y, x
                if len(y) < needed(len(x), t):
                    keep.append(False)
                    continue
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                same = int((x[at] == y).sum())
                keep.append(10_000 * same >= round(t * 10_000) * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _prefixes(sets: DataFrame, frequent: DataFrame, t: float) -> DataFrame:
    """(doc_id, p, tokens) of each document: its tokens in the order (frequent or not, hash), the first p of them for its lists."""
    own = sets.select("doc_id", F.explode("tokens").alias("token")).join(C.small_side(frequent), "token").groupBy("doc_id").agg(F.collect_list("token").alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens, last = (batch.column(i) for i in range(3))
            size, out = [], []
            for i in range(batch.num_rows):
                s = tokens[i].values.to_numpy()
                p = len(s) - needed(len(s), t) + 1
                if last[i].is_valid:
                    late = np.isin(s, last[i].values.to_numpy())
                    s = np.concatenate((s[~late], s[late]))
                size.append(p)
                out.append(s)
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int32()), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "p", "tokens"])

    return sets.join(own, "doc_id", "left").select("doc_id", "tokens", "last").mapInArrow(run, "doc_id long, p int, tokens array<long>")


def link_components(docs: DataFrame, k: int = 5, t: float = 0.8, long_list: int = LONG_LIST, stars: int = STARS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs(doc_id, text).

    component_id is the smallest doc_id reachable by links of similarity at least t, itself included. Documents with
    equal sets are linked; those without a shingle (null, empty or blank text) link with nothing. Rows that share a
    doc_id are one document for the links; a row whose doc_id is null links with nothing and has a null component_id.
    """
    docs = docs.select("doc_id", "text")
    keys = C.cut(_sets(docs, k, "key", t))
    classes = C.cut(keys.where("doc_id is not null and n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    repeated = C.cut(keys.where("doc_id is not null and n > 0").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    member = keys.join(classes.where("copies > 1").select("h1", "h2", "rep"), ["h1", "h2"]).where("doc_id != rep").select("doc_id", "rep")
    copies = C.cut(member.join(C.small_side(repeated), "doc_id", "left_anti").select("doc_id"))
    same_id = keys.join(C.small_side(repeated), "doc_id", "left_semi").join(classes, ["h1", "h2"]).where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    once = docs.join(C.small_side(copies), "doc_id", "left_anti")
    low = _sets(once, k, "low", t).select("doc_id", "need", F.explode("low").alias("token"))
    counts = low.groupBy("token").count().where("count > 1")
    met = C.cut(low.join(counts, "token").select("token", "doc_id", "need", (F.col("count") > long_list).cast("int").alias("long")))
    least = (F.first("need") - F.sum("long")).cast("int")
    near = C.cut(met.groupBy("doc_id").agg(F.count("*").alias("m"), F.first("need").alias("need"), least.alias("least")).where("m >= need").select("doc_id", "least"))
    pairs = C.cut(_candidates(met.where("long = 0").select("token", "doc_id").join(C.small_side(near), "doc_id")))
    hard = C.cut(near.where("least <= 0").select("doc_id"))
    ids = C.cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionByName(hard).distinct())
    sets = C.cut(_sets(docs.join(C.small_side(ids), "doc_id", "left_semi"), k, "set", t))
    hard_sets = sets.join(C.small_side(hard), "doc_id", "left_semi")
    frequent = C.cut(hard_sets.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") > long_list).select("token"))
    firsts = C.cut(_prefixes(hard_sets, frequent, t))
    short = firsts.select("doc_id", F.explode(F.slice("tokens", F.lit(1), F.col("p"))).alias("token"))
    first = C.cut(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionByName(_stars(short, stars)).distinct())
    linked = C.cut(_probe(first, sets, t).unionByName(same_id))
    found = C.cut(C.components(linked))
    few, many = _apart(short, firsts, found, long_list, t, block)
    rest = _between(pairs.join(first, ["a", "b"], "left_anti"), found).unionByName(few).distinct()
    more = C.cut(_probe(rest.join(first, ["a", "b"], "left_anti"), sets, t).unionByName(many))
    if not more.isEmpty():
        joined = _rooted(more, found).select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        found = C.cut(C.components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(joined)))
    roots = classes.join(found.select(F.col("id").alias("rep"), "root"), "rep", "left").select("h1", "h2", F.coalesce("root", "rep").alias("c"))
    out = keys.join(roots, ["h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))
    return out


def _pairs(lists: DataFrame) -> DataFrame:
    """(x, y, c) of lists (docs sorted, c): all pairs of short lists."""
    return lists.select(F.posexplode("docs").alias("i", "x"), "docs", "c").select("x", F.explode(F.slice("docs", F.col("i") + 2, F.size("docs"))).alias("y"), "c")


def _candidates(short: DataFrame) -> DataFrame:
    """Pairs (a < b) of (token, doc_id, least) with as many lists in common as each asks for; equal lists are counted, not repeated."""
    lists = short.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("doc_id", "least"))).alias("docs")).where(F.size("docs") > 1)
    lists = lists.groupBy("docs").agg(F.count("*").alias("c"))
    both = _pairs(lists).where("x.doc_id < y.doc_id").select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), "c", F.greatest("x.least", "y.least").alias("least"))
    return both.groupBy("a", "b").agg(F.sum("c").alias("s"), F.max("least").alias("least")).where("s >= least").select("a", "b")


def _stars(short: DataFrame, stars: int) -> DataFrame:
    """Pairs of each document and some leaders: of each kind the one that leads most of its lists."""
    leaders = short.groupBy("token").agg(F.count("*").alias("size"), *(F.min_by("doc_id", F.xxhash64(F.lit(i), "doc_id")).alias(f"l{i}") for i in range(stars)))
    each = short.join(leaders.where("size > 1"), "token").select("doc_id", F.posexplode(F.array(*(f"l{i}" for i in range(stars)))).alias("kind", "l")).where("doc_id != l")
    most = each.groupBy("doc_id", "kind", "l").count().groupBy("doc_id", "kind").agg(F.max_by("l", F.struct("count", "l")).alias("l"))
    return most.select(F.least("doc_id", "l").alias("a"), F.greatest("doc_id", "l").alias("b")).distinct()


def _rooted(pairs: DataFrame, found: DataFrame) -> DataFrame:
    root = lambda x: found.select(F.col("id").alias(x), F.col("root").alias(f"r{x}"))
    return pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")


def _between(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs that are not known to be connected."""
    return _rooted(pairs, found).where("coalesce(ra, a) != coalesce(rb, b)").select("a", "b")


def _apart(short: DataFrame, firsts: DataFrame, found: DataFrame, long_list: int, t: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Of documents that share a list and are not known to be connected: pairs (a < b) of short lists, and links of long ones.

    Of the links of two blocks, those that join components suffice; so the rows are fewer than the documents of both.
    """
    rooted = short.join(found.select(F.col("id").alias("doc_id"), "root"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    mixed = C.cut(rooted.groupBy("token").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("token", "size"))
    rooted = rooted.join(mixed, "token")
    # equal lists of different tokens give the same pairs: each distinct list counts once
    lists = rooted.where(F.col("size") <= long_list).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("doc_id", "root"))).alias("docs")).select("docs").distinct()
    few = _pairs(lists.withColumn("c", F.lit(1))).where("x.root != y.root")
    few = few.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    sided = rooted.where(F.col("size") > long_list).withColumn("blocks", F.ceil(F.col("size") / block)).withColumn("side", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    spread = sided.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("token", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "doc_id", "root")
    keys = ["token", "i", "j"]
    spread = spread.join(firsts, "doc_id").select(*keys, "side", "doc_id", "root", "p", "tokens").repartition(*keys).sortWithinPartitions(*keys, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in C.groups(batches, len(keys)):
            side, ids, root, p = (group.column(c).to_numpy() for c in ("side", "doc_id", "root", "p"))
            tokens = group.column("tokens").combine_chunks()
            flat, offsets = tokens.values.to_numpy(), tokens.offsets.to_numpy()
            lists = [flat[x:y] for x, y in zip(offsets[:-1], offsets[1:])]
            near = _near(lists, p, group.column("token")[0].as_py()) & (root[:, None] != root[None, :])
            if group.column("i")[0] != group.column("j")[0]:
                near &= side[:, None] != side[None, :]
            a, b = _joining(lists, near, root, t)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return few, spread.mapInArrow(run, "a long, b long")


def _near(lists: list[np.ndarray], p: np.ndarray, token: int) -> np.ndarray:
    """Matrix of pairs i < j that may be linked, by what they share of their first tokens, and share none of the first p below this one."""
    heads = [x[: 2 * n] for x, n in zip(lists, p)]
    size = np.array([len(x) for x in heads])
    need = np.maximum(size - p, 1)  # one less than is shared: the bound can be off by one for very small sets
    distinct, at, count = np.unique(np.concatenate(heads), return_inverse=True, return_counts=True)
    row, column = np.repeat(np.arange(len(heads)), size), np.cumsum(count > 1) - 1
    met = count[at] > 1
    early = (distinct[at] < token) & (np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) < np.repeat(p, size))
    same, before = np.zeros((2, len(heads), len(heads)), np.float32)
    for lo in range(0, int(column[-1]) + 1, 4096):  # in strips: memory is bounded whatever the lists hold
        part = met & (column[at] >= lo) & (column[at] < lo + 4096)
        for sums, of in ((same, part), (before, part & early)):
            cells = column[at][of] - lo
            if len(cells):
                has = np.zeros((len(heads), int(cells.max()) + 1), np.float32)
                has[row[of], cells] = 1
                sums += has @ has.T
    return np.triu((same >= np.maximum(need[:, None], need[None, :])) & (before == 0), 1)


def _joining(lists: list[np.ndarray], near: np.ndarray, root: np.ndarray, t: float) -> tuple[list[int], list[int]]:
    """Of the pairs of the matrix, links (rows, columns) that join what is not yet connected: a spanning forest of the components."""
    size, share = np.array([len(x) for x in lists]), round(t * 10_000)
    group, out = np.unique(root, return_inverse=True)[1], ([], [])
    for i in np.flatnonzero(near.any(axis=1)):
        others, mine = np.flatnonzero(near[i]), np.sort(lists[i])
        others = others[share * np.maximum(size[others], size[i]) <= 10_000 * np.minimum(size[others], size[i])]
        for lo, hi in C.slices(size[others].tolist(), PROBED):
            some = others[lo:hi][group[others[lo:hi]] != group[i]]
            if not len(some):
                continue
            theirs = np.concatenate([lists[j] for j in some])
            at = np.searchsorted(mine, theirs)
            at[at == len(mine)] = 0
            same = np.add.reduceat((mine[at] == theirs).astype(np.int64), np.cumsum(size[some]) - size[some])
            for j in some[10_000 * same >= share * (size[some] + size[i] - same)]:
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
                    out[0].append(i)
                    out[1].append(j)
    return out


def near_duplicates_out(docs: DataFrame, k: int = 5, t: float = 0.8) -> DataFrame:
    """docs with one document of each component left, the one with the smallest doc_id; all columns are kept.

    Documents without a shingle or without an id stay. Of rows that share a kept doc_id, all stay.
    """
    gone = C.cut(link_components(docs, k, t).where("doc_id != component_id").select("doc_id").distinct())
    return docs.join(C.small_side(gone), "doc_id", "left_anti").select(docs.columns)
