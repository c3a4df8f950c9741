"""Near-duplicate lines by deletion neighbourhoods, in SQL expressions only.

Two lines are alike if they are equal, or if both have LEAST_WORDS words or more and differ by one edit: a word (what single blanks
part) put in, left out or replaced, none of the words concerned having more than a SHARE-th of the characters of all the others. So
the bound in characters is in proportion to the line's length, and short lines match equal ones only. A line's variants are the line
itself and the line without one of its (short enough) words, emitted as hashed keys:

    replaced: hash(sums over j of hash(word j, j) less that of place i, i, number of words)
    whole:    hash(sums over j of hash(word j, word j + 1), number of words), the ends counting as words
    dropped:  the key that the line without word i would have: two neighbour hashes go from the sums, that of the new neighbours comes

The bound looks at the words left over, which are the same for all lines of a key. So lines that share a key "replaced" are alike all
together, and holding each against the key's earliest line is enough. A "whole" key meets "dropped" keys of lines with a word more: the
shorter line is held against the earliest of these, these against the shorter one. Keys are reduced to their earliest lines before a
shuffle, however many lines share them. Candidates are verified on their words.

Lines are first made distinct. Then a lossless test leaves most out: let h be the largest power of two that is half of the number of
words at most. One edit leaves the first h words or the last h words as they are; a line that shares neither with any other distinct line
is alike to none. (A number of words that is a power of two is tested with h / 2 also, as a line with a word less has that h.)
Those that stay are tested again by quarters: an edit lies in one quarter of the longer line, and the other three are as they were.

A line's place is one number made of doc_id, a hash of the whole text and line_no: its name and its rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C
from quire.llm.quality import _BLANKS

#: Words, blank ones not counted, from which on a line is held against others that are not equal (4 at least). An edited word has this share of the others' characters at most.
LEAST_WORDS, SHARE = 8, 8
_LOW = (1 << 32) - 1


def document_place(doc_id: Column, text: Column) -> Column:
    """The place of a document: doc_id first (null before all others), then a hash of the text; rows equal in both have one place."""
    of_null = F.lit(-(1 << 63)).cast("decimal(20,0)") - 1 - F.xxhash64(F.lit(5), text).bitwiseAND(F.lit((1 << 63) - 1)).cast("decimal(20,0)")
    order = F.coalesce(doc_id.cast("decimal(20,0)"), of_null.cast("decimal(20,0)"))
    return (order * F.lit(1 << 30).cast("decimal(10,0)") + F.xxhash64(text).bitwiseAND(F.lit((1 << 30) - 1)).cast("decimal(10,0)")).cast("decimal(30,0)")


def lines_of(docs: DataFrame) -> DataFrame:
    """(document, line_no, o, line) of each \\n-split line with a word; document and o are places."""
    split = docs.select(document_place(F.col("doc_id"), F.col("text")).alias("document"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    place = (F.col("document") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no").cast("decimal(10,0)")).cast("decimal(38,0)")
    return split.where(F.btrim("line", F.lit(_BLANKS)) != "").select("document", "line_no", place.alias("o"), "line")


def _sums(hashes: Column) -> tuple[Column, Column]:
    """Sums of the halves of 64-bit hashes: no overflow, and terms can be taken out."""
    add = lambda f: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: a + f(x))
    return add(_hi), add(_lo)


def _hi(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def _lo(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words differ by at most one word put in, left out or replaced, each word concerned being short enough."""
    n, m = F.size(a), F.size(b)
    short, long = F.least(n, m), F.greatest(n, m)

    def same(x: Column, y: Column) -> Column:
        differs = F.array_position(F.zip_with(x, y, lambda p, q: F.when(p.eqNullSafe(q), F.lit(0)).otherwise(F.lit(1))), 1)
        return F.when(differs == 0, long.cast("long")).otherwise(differs - 1)

    def fits(x: Column) -> Column:
        own = F.coalesce(F.length(F.get(x, same(a, b).cast("int"))), F.lit(0))
        return SHARE * own <= F.length(F.array_join(x, "")) - own

    return (long - short <= 1) & (same(a, b) + same(F.reverse(a), F.reverse(b)) >= long - 1) & ((n < m) | fits(a)) & ((m < n) | fits(b))


def _variants(lines: DataFrame) -> DataFrame:
    """(key, o, kind) of the variants of lines (o, w): kind 0 whole, 1 dropped, 2 replaced."""
    n = F.size("w")
    edge = F.array(F.lit("\n"))  # no word
    a = lines.select("o", n.alias("n"), F.length(F.array_join("w", "")).alias("total"), F.concat(edge, F.col("w"), edge).alias("e"), F.transform("w", lambda x, i: F.struct(F.xxhash64(x, i).alias("hp"), F.length(x).alias("own"))).alias("x"))
    pair = lambda x, y: F.xxhash64(x, y)
    part = lambda i, less: F.slice("e", F.lit(i), F.size("e") - less)
    a = a.select("o", "n", "total", F.col("x.hp").alias("hp"), F.col("x.own").alias("own"), F.zip_with(part(1, 1), part(2, 1), pair).alias("hl"), F.zip_with(part(1, 2), part(3, 2), pair).alias("new"))
    a = a.select("*", *(x.alias(f"p{i}") for i, x in enumerate(_sums(F.col("hp")))), *(x.alias(f"s{i}") for i, x in enumerate(_sums(F.col("hl")))))
    one = F.arrays_zip("hp", "own", F.slice("hl", F.lit(1), F.col("n")).alias("l"), F.slice("hl", F.lit(2), F.col("n")).alias("r"), "new")
    a = a.select("o", "n", "total", "p0", "p1", "s0", "s1", F.posexplode(one).alias("i", "z"))
    less = [F.col(f"s{i}") - f(F.col("z.l")) - f(F.col("z.r")) + f(F.col("z.new")) for i, f in enumerate((_hi, _lo))]
    keys = [F.xxhash64("s0", "s1", "n"), F.xxhash64(*less, F.col("n") - 1), F.xxhash64(F.col("p0") - _hi(F.col("z.hp")), F.col("p1") - _lo(F.col("z.hp")), "i", "n")]
    fits = SHARE * F.col("z.own") <= F.col("total") - F.col("z.own")
    made = [F.when(test, F.struct(k.alias("key"), F.lit(kind).alias("kind"))) for (kind, k), test in zip(enumerate(keys), (F.col("i") == 0, fits, fits))]
    return a.select("o", F.inline(F.filter(F.array(*made), lambda x: x.isNotNull())))


def _half(line: Column, h: Column) -> list[Column]:
    """Hashes of the first h and of the last h words."""
    return [F.xxhash64(F.lit(side), h, F.call_function("substring_index", line, F.lit(" "), h if side == 0 else -h)) for side in (0, 1)]


def _less_quarters(line: Column) -> list[Column]:
    """Hashes of a line without one of its quarters, as the longer and as the shorter line of a pair: N words, or one less than N.

    A quarter is a range of places of the longer line. What stands before it is counted from the start, what stands after it from the
    end, so that a word put in or left out moves nothing.
    """
    n = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    out = []
    for of in (n, n + 1):
        for q in range(4):
            before, after = (of * q / 4).cast("int"), of - (of * (q + 1) / 4).cast("int")
            part = lambda words: F.call_function("substring_index", line, F.lit(" "), words)
            out.append(F.xxhash64(F.lit(q), of, part(before), part(-after)))
    return out


def _sharing(ends: DataFrame) -> DataFrame:
    """The distinct o of the rows (o, e) whose e belongs to more than one row."""
    shared = C.cut(ends.groupBy("e").agg(F.count("*").alias("c")).where("c > 1").select("e"))
    return C.cut(ends.join(C.small_side(shared), "e", "left_semi").select("o").distinct())


def duplicates(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(document, line_no) of the lines to leave out: those with an alike line at an earlier place.

    A line is measured against all earlier lines, whether or not they stay. Documents are ordered by doc_id (null first), those of
    one doc_id by a hash of their text. Rows equal in doc_id and text share their places, so what the first keeps the others keep.
    """
    least_words = max(least_words, 4)
    line = lines_of(docs)
    n = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    h = F.expr("shiftleft(1, length(bin(n)) - 2)")
    keyed = line.select("document", "line_no", "o", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"), "line", n.alias("n")).withColumn("h", F.when(F.col("n") >= least_words, h))
    twice = F.when((F.col("n") == 2 * F.col("h")) & (F.col("n") > least_words), F.expr("h div 2").cast("int"))
    halves = [F.when(x.isNotNull(), y).alias(f"e{k}{i}") for k, x in enumerate((F.col("h"), twice)) for i, y in enumerate(_half(F.col("line"), x))]
    distinct = C.cut(keyed.select("k1", "k2", "o", *halves).groupBy("k1", "k2").agg(F.min("o").alias("o"), F.max("o").alias("last"), *(F.max(c).alias(c) for c in ("e00", "e01", "e10", "e11"))))
    suspects = _sharing(distinct.select("o", F.explode(F.array_compact(F.array("e00", "e01", "e10", "e11"))).alias("e")))
    # cut before the words are counted: the optimiser would count those of all lines, before the join
    suspect = C.cut(line.join(C.small_side(suspects), "o").select("o", "line"))
    worded = suspect.where(F.size(F.filter(F.split("line", " ", -1), lambda w: F.btrim(w, F.lit(_BLANKS)) != "")) >= least_words)
    near_ones = _sharing(worded.select("o", F.explode(F.array(*_less_quarters(F.col("line")))).alias("e")))
    lines = C.cut(suspect.join(C.small_side(near_ones), "o").select("o", F.split("line", " ", -1).alias("w")))
    variants = _variants(lines)
    low = lambda test: F.min(F.when(test, F.col("o")))
    keys = variants.groupBy("key").agg(F.count("*").alias("c"), F.min("o").alias("lo"), F.max("o").alias("hi"), F.min("kind").alias("kind"), low(F.col("kind") == 0).alias("whole"), low(F.col("kind") != 0).alias("other"))
    keys = C.cut(keys.where("lo < hi and (kind = 2 or whole is not null)").drop("kind"))
    # most keys have two variants and so name their pair; only those of more go back to their variants
    many = C.cut(keys.where("c > 2").select("key", "whole", "other"))
    met = variants.join(C.small_side(many), "key").select("o", F.when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("other")).alias("p")).where("p < o")
    pairs = C.cut(met.unionByName(keys.where("c = 2").select(F.col("hi").alias("o"), F.col("lo").alias("p"))).distinct())
    text = lambda x, w: lines.select(F.col("o").alias(x), F.col("w").alias(w))
    both = pairs.join(text("o", "x"), "o").join(text("p", "y"), "p")
    near = C.cut(both.where(one_edit(F.col("x"), F.col("y"))).select("o").distinct()).withColumn("near", F.lit(True))
    # only texts with several places, or with an earlier alike line, lose any
    lose = distinct.join(C.small_side(near), "o", "left").where("near or o != last").select("k1", "k2", F.when(F.col("near").isNull(), F.col("o")).alias("stays"))
    hit = keyed.select("document", "line_no", "o", "k1", "k2").join(lose, ["k1", "k2"])
    return hit.where("stays is null or stays != o").select("document", "line_no")


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, counts: bool = True) -> DataFrame:
    """docs with each line kept at its earliest place only (see duplicates()); n_chars, if there, follows the text.

    With counts, n_lines (lines with a word, before) and n_removed follow, named n_lines_1 and so on where docs has such columns. Lines
    without a word stay. Null text stays null with counts of 0, an empty text stays empty; a document may lose all its lines and then has
    an empty text. An empty table gives no rows; repeated rows each stay and get the same text.
    """
    # what goes grows with the corpus, so this join shuffles whole texts (once, not their lines as well) at every size
    by_document = duplicates(docs, least_words).groupBy("document").agg(F.collect_set("line_no").alias("gone"))
    both = C.packed(docs, document_place(F.col("doc_id"), F.col("text")).alias("document")).join(by_document, "document", "left").withColumn("lines", F.split(C.own("text"), "\n", -1))
    left = F.array_join(F.filter("lines", lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    count = F.when(F.col("lines").isNull(), 0).otherwise(F.size(F.filter("lines", lambda x: F.btrim(x, F.lit(_BLANKS)) != "")))
    lost = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    text = F.when(F.col("gone").isNull(), C.own("text")).otherwise(left)
    return C.unpacked(both, docs, text, {"n_lines": count.cast("long"), "n_removed": lost.cast("long")} if counts else {})
