"""Operators over sections(book_id, section_index, href, plain_text): one row for each section of each book of a corpus.

Nearly all are built-in expressions (literal search and TTS tokens scan Arrow batches). What concerns one section stays in its row; only what spans sections (locations, fingerprints)
or the corpus (keywords, duplicates) shuffles, on book_id or the key, with partial aggregation.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

#: Fixed value: words that are no keywords.
STOP_WORDS = (
    "the and is of to in that it with for as was on are by at an be this which from or have had has not but what all were when we there can"
    " your how her him his them their into some than then now only other its also out"
).split()


def _starts(lengths: Column) -> Column:
    """Running sums before each element."""
    both = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")))
    return both["out"]


def _hits(sections: DataFrame, gaps: Column, lengths: Column, around: int) -> DataFrame:
    """Rows for the matches between gaps: offset, snippet, address."""
    keys = ["book_id", "section_index", "href"]
    parts = sections.select(*keys, "plain_text", F.transform(gaps, F.length).alias("g"), lengths.alias("l"))
    # match k starts after gaps 0 to k and matches 0 to k - 1
    both = F.zip_with(F.slice("g", F.lit(1), F.size("l")), F.col("l"), lambda g, n: g + n)
    at = parts.select(*keys, "plain_text", "l", F.zip_with(_starts(both), F.slice("g", F.lit(1), F.size("l")), lambda s, g: s + g).alias("at"))
    hit = at.select(*keys, "plain_text", F.inline(F.zip_with("at", "l", lambda a, n: F.struct(a.cast("long").alias("char_offset"), n.alias("n")))))
    a, n = F.col("char_offset"), F.col("n")
    start = F.greatest(a - around, F.lit(0))
    before = F.substring("plain_text", (start + 1).cast("int"), (a - start).cast("int"))
    found = F.substring("plain_text", (a + 1).cast("int"), n)
    after = F.substring("plain_text", (a + n + 1).cast("int"), F.lit(around))
    dots = lambda test: F.when(test, "...").otherwise("")
    snippet = F.concat(dots(start > 0), T.html_escape(before), F.lit("<mark>"), T.html_escape(found), F.lit("</mark>"), T.html_escape(after), dots(a + n + around < F.length("plain_text")))
    return hit.select("book_id", F.col("section_index").cast("long").alias("spine_index"), "char_offset", T.cfi(F.col("section_index"), F.col("href"), a).alias("cfi"), snippet.alias("snippet"))


_ESCAPED = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"})


def search(sections: DataFrame, query: str, around: int = 40) -> DataFrame:
    """Case-insensitive literal hits, left to right without overlap: (book_id, spine_index, char_offset, cfi, snippet). A blank query has none.

    Sections without a hit never leave the JVM; the others are scanned once each, in time linear in their length and hits.
    """
    some, low = sections.where(F.lower("plain_text").contains(query.lower())) if query.strip() else sections.limit(0), query.lower()
    schema = f"book_id {sections.schema['book_id'].dataType.simpleString()}, spine_index long, char_offset long, cfi string, snippet string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                index, href, text = (batch.column(c)[i].as_py() for c in (1, 2, 3))
                folded, size, at, offsets = text.lower(), len(text), [], []
                k = folded.find(low)
                while k >= 0:
                    at.append(k)
                    k = folded.find(low, k + len(low))
                esc = lambda x: x.translate(_ESCAPED)
                head = f"epubcfi(/6/{2 * (index + 1)}{f'[{href}]' if href else ''}!/4/2/1:"
                for lo in range(0, len(at), 10_000):
                    part = at[lo : lo + 10_000]
                    offsets = [f"{head}{a})" for a in part]
                    snippets = [f"{'...' if a > around else ''}{esc(text[max(a - around, 0) : a])}<mark>{esc(text[a : a + len(low)])}</mark>{esc(text[a + len(low) : a + len(low) + around])}{'...' if a + len(low) + around < size else ''}" for a in part]
                    ids = pa.repeat(batch.column(0)[i], len(part))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([index] * len(part), pa.int64()), pa.array(part, pa.int64()), pa.array(offsets, pa.string()), pa.array(snippets, pa.string())], ["book_id", "spine_index", "char_offset", "cfi", "snippet"])

    return some.select("book_id", F.col("section_index").cast("long").alias("section_index"), "href", "plain_text").mapInArrow(run, schema)


def search_regex(sections: DataFrame, pattern: str, around: int = 40) -> DataFrame:
    """Hits of a regular expression that matches at least one character."""
    gaps, found = F.split("plain_text", pattern, -1), F.regexp_extract_all("plain_text", F.lit(pattern), F.lit(0))
    return _hits(sections.where(F.col("plain_text").rlike(pattern)), gaps, F.transform(found, F.length), around)


def top_hits(hits: DataFrame, most: int = 500) -> DataFrame:
    return hits.orderBy("book_id", "spine_index", "char_offset").limit(most)


def words(text: Column) -> Column:
    """Words split at white space, without leading and trailing characters other than letters and digits: one pass of one pattern."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)[\p{L}\p{N}](?:\S*[\p{L}\p{N}])?"), F.lit(0))


def analytics(sections: DataFrame) -> DataFrame:
    """(book_id, section_index, word_count, reading_time_minutes, difficulty_score)."""
    w = sections.select("book_id", "section_index", words(F.col("plain_text")).alias("w"))
    n = F.size("w")
    letters = F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x))
    mean = letters.cast("float") / n.cast("float")
    score = F.when(n == 0, 0.0).otherwise(F.round(F.least((mean.cast("float") * F.lit(1.5).cast("float")).cast("double"), F.lit(10.0)), 1))
    return w.select("book_id", "section_index", n.cast("long").alias("word_count"), (F.floor((n + 10) / 20) / 10).alias("reading_time_minutes"), score.alias("difficulty_score"))


def keyword_counts(sections: DataFrame, *by: str) -> DataFrame:
    """(*by, word, n) of lower-cased words of three bytes or more that are no stop words."""
    w = sections.select(*by, F.explode(words(F.col("plain_text"))).alias("w")).select(*by, F.lower("w").alias("word"))
    return w.where((F.octet_length("word") >= 3) & ~F.col("word").isin(*STOP_WORDS)).groupBy(*by, "word").agg(F.count("*").alias("n"))


def top_keywords(counts: DataFrame, by: list[str], most: int = 10) -> DataFrame:
    """The most frequent words of each group; ties go by the word."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def fingerprints(sections: DataFrame) -> DataFrame:
    """(book_id, content_hash, total_sections, total_characters): SHA-256 over the sections' text without white space, in order."""
    bare = F.regexp_replace("plain_text", r"(?U)\s", "")
    both = sections.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("section_index", bare.alias("t")))).alias("s"), F.count("*").alias("total_sections"), F.sum(F.length("plain_text")).cast("long").alias("total_characters"))
    return both.select("book_id", F.sha2(F.array_join(F.transform("s", lambda x: x["t"]), ""), 256).alias("content_hash"), "total_sections", "total_characters")


def metadata_hash(title: Column, creator: Column, identifier: Column) -> Column:
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.sha2(F.concat_ws(":", clean(title), clean(creator), clean(identifier)), 256)


def duplicate_groups(prints: DataFrame) -> DataFrame:
    """(book_id, leader): books of equal content and the smallest book_id among them; no pairs, so groups of any size are one row a book."""
    lead = prints.groupBy("content_hash").agg(F.min("book_id").alias("leader"), F.count("*").alias("c")).where("c > 1").select("content_hash", "leader")
    return prints.join(lead, "content_hash").select("book_id", "leader")


def match_score(a: str, b: str) -> Column:
    """Similarity of two fingerprints (struct columns with content_hash, metadata_hash, total_sections, total_characters)."""
    c = lambda x, n: F.col(f"{x}.{n}")
    low, high = F.least(c(a, "total_characters"), c(b, "total_characters")), F.greatest(c(a, "total_characters"), c(b, "total_characters"))
    near = F.when(high > 0, low / high).otherwise(0.0)
    sized = (c(a, "total_sections") == c(b, "total_sections")) & (c(a, "total_characters") > 0)
    meta = c(a, "metadata_hash") == c(b, "metadata_hash")
    return F.when(c(a, "content_hash") == c(b, "content_hash"), 1.0).when(meta & sized, 0.6 + 0.4 * near).when(meta, 0.5).when(sized, 0.8 * near).otherwise(0.0)


def locations(sections: DataFrame, chunk: int = 1024) -> DataFrame:
    """(book_id, location, spine_index, char_start, char_end): numbered through the book; an empty section has one location."""
    n = F.length("plain_text")
    rows = F.greatest(F.ceil(n / chunk), F.lit(1))
    before = F.coalesce(F.sum(rows).over(Window.partitionBy("book_id").orderBy("section_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = sections.select("book_id", "section_index", n.alias("n"), rows.alias("rows"), before.alias("before"))
    each = numbered.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("k"))
    return each.select("book_id", (F.col("before") + F.col("k") + 1).cast("long").alias("location"), F.col("section_index").cast("long").alias("spine_index"), (F.col("k") * chunk).cast("long").alias("char_start"), F.least((F.col("k") + 1) * chunk, F.col("n")).cast("long").alias("char_end"))


@dataclass(frozen=True)
class Page:
    """Layout that pages are computed for."""

    width: int = 800
    height: int = 600
    margin: int = 32
    font: int = 16
    line_height: float = 1.6

    @property
    def characters(self) -> int:
        across = max(int(max(self.width - 2 * self.margin, 200) / (self.font * 0.55)), 10)
        down = max(int(max(self.height - 2 * self.margin, 200) / (self.font * self.line_height)), 4)
        return max(across * down, 100)


def paginate(sections: DataFrame, page: Page = Page()) -> DataFrame:
    """(book_id, section_index, page_number, start_char, end_char)."""
    n, size = F.length("plain_text"), page.characters
    each = sections.select("book_id", "section_index", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(n / size), F.lit(1)) - 1)).alias("p"))
    return each.select("book_id", "section_index", (F.col("p") + 1).cast("long").alias("page_number"), (F.col("p") * size).cast("long").alias("start_char"), F.least((F.col("p") + 1) * size, F.col("n")).cast("long").alias("end_char"))


@dataclass(frozen=True)
class Chunking:
    """Sizes in tokens of four bytes; min_chunk in bytes."""

    max_tokens: int = 512
    overlap_tokens: int = 64
    min_chunk: int = 50


def rag_chunks(sections: DataFrame, config: Chunking = Chunking()) -> DataFrame:
    """(book_id, section_index, chunk_id, chunk_index, start_char, body, token_estimate, cfi): non-empty lines packed greedily.

    A chunk is closed when the next line would take it past its size and it has min_chunk bytes; the tail of overlap_tokens * 4
    characters is carried on. Lines are never split; a last chunk below min_chunk is left out. start_char counts in the lines joined by \\n.
    """
    lines = F.filter(F.transform(F.split("plain_text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    most, tail = 4 * config.max_tokens, 4 * config.overlap_tokens
    zero = F.struct(F.lit("").alias("cur"), F.lit(0).alias("start"), F.lit(0).alias("off"), F.array().cast("array<struct<start:int,body:string>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        full = (F.octet_length(a["cur"]) + F.octet_length(p) > most) & (F.octet_length(a["cur"]) >= config.min_chunk)
        done = F.array_append(a["out"], F.struct(a["start"].alias("start"), a["cur"].alias("body")))
        over = F.concat(F.right(a["cur"], F.lit(tail)), F.lit("\n"), p) if tail else p
        from_ = F.greatest(a["off"] - 1 - F.least(F.lit(tail), F.length(a["cur"])), F.lit(0)) if tail else a["off"]
        return F.struct(
            F.when(a["cur"] == "", p).when(full, over).otherwise(F.concat(a["cur"], F.lit("\n"), p)).alias("cur"),
            F.when(a["cur"] == "", a["off"]).when(full, from_).otherwise(a["start"]).alias("start"),
            (a["off"] + F.length(p) + 1).alias("off"),
            F.when((a["cur"] != "") & full, done).otherwise(a["out"]).alias("out"),
        )

    def finish(a: Column) -> Column:
        return F.when(F.octet_length(F.trim(a["cur"])) >= config.min_chunk, F.array_append(a["out"], F.struct(a["start"].alias("start"), a["cur"].alias("body")))).otherwise(a["out"])

    each = sections.select("book_id", "section_index", "href", F.posexplode(F.aggregate(lines, zero, step, finish)).alias("k", "c"))
    return each.select("book_id", "section_index", F.format_string("chunk-sec-%d-%d", F.col("section_index").cast("long"), "k").alias("chunk_id"), F.col("k").cast("long").alias("chunk_index"), F.col("c.start").cast("long").alias("start_char"), F.col("c.body").alias("body"), F.ceil(F.octet_length("c.body") / 4).cast("long").alias("token_estimate"), T.cfi(F.col("section_index"), F.col("href"), F.col("c.start")).alias("cfi"))


def tts_tokens(sections: DataFrame) -> DataFrame:
    """(book_id, section_index, token_index, word, start_char, end_char) of text whose white space is made single blanks; linear in its length."""
    kinds = ", ".join(f"{c} {sections.schema[c].dataType.simpleString()}" for c in ("book_id", "section_index"))
    text = F.trim(F.regexp_replace("plain_text", r"\s+", " "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = (batch.column(2)[i].as_py() or "").split(" ")
                ends = np.cumsum([len(w) + 1 for w in found]) - 1
                for lo in range(0, len(found), 50_000):
                    part = [k for k in range(lo, min(lo + 50_000, len(found))) if found[k]]
                    stop = ends[part]
                    size = np.array([len(found[k]) for k in part], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(part)), pa.repeat(batch.column(1)[i], len(part)), pa.array(part, pa.int64()), pa.array([found[k] for k in part], pa.string()), pa.array(stop - size), pa.array(stop)], ["book_id", "section_index", "token_index", "word", "start_char", "end_char"])

    return sections.select("book_id", "section_index", text.alias("t")).mapInArrow(run, f"{kinds}, token_index long, word string, start_char long, end_char long")


def validation(books: DataFrame) -> DataFrame:
    """(book_id, code, severity) of books(book_id, title, identifier, language, creator, n_spine, n_sections, n_toc, access_modes)."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rules = [
        ("PKG-001", "Error", blank("title")), ("PKG-002", "Warning", blank("identifier")), ("PKG-003", "Warning", blank("language")), ("PKG-004", "Info", blank("creator")),
        ("RSC-001", "Error", F.col("n_spine") == 0), ("RSC-002", "Error", F.col("n_sections") == 0), ("NAV-001", "Warning", F.col("n_toc") == 0), ("A11Y-001", "Info", F.size("access_modes") <= 0),
    ]
    found = F.filter(F.array(*(F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, test in rules)), lambda x: x.isNotNull())
    return books.select("book_id", F.inline(found))


def year(date: Column) -> Column:
    digits = F.regexp_replace(date, "[^0-9]", "")
    return F.when(F.length(digits) >= 4, F.substring(digits, 1, 4))


def citations(books: DataFrame) -> DataFrame:
    """(book_id, cite_key, apa, mla) of books(book_id, title, creator, publisher, pub_date)."""
    alnum = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    names = F.filter(F.split(F.coalesce("creator", F.lit("")), r"\s+"), lambda x: x != "")
    last, firsts = F.element_at(names, -1), F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0)))
    many = F.size(names) > 1
    key = F.concat(alnum(F.when(F.size(names) > 0, last).otherwise("author")), F.coalesce(year(F.col("pub_date")), F.lit("2026")), alnum(F.coalesce(F.get(F.filter(F.split("title", r"\s+"), lambda x: x != ""), F.lit(0)), F.lit("book"))))
    apa_author = F.when(F.size(names) == 0, "Unknown Author").when(many, F.concat(last, F.lit(", "), F.array_join(F.transform(firsts, lambda x: F.concat(F.substring(x, 1, 1), F.lit("."))), " "))).otherwise(F.col("creator"))
    y = F.coalesce(F.concat(F.lit("("), year(F.col("pub_date")), F.lit(")")), F.lit("(n.d.)"))
    pub = F.when(F.coalesce(F.col("publisher"), F.lit("")) != "", F.concat(F.lit(" "), F.col("publisher"), F.lit("."))).otherwise("")
    inverted = F.when(many, F.concat(last, F.lit(", "), F.array_join(firsts, " "))).otherwise(F.coalesce("creator", F.lit("")))
    return books.select("book_id", key.alias("cite_key"), F.concat(apa_author, F.lit(" "), y, F.lit(". *"), F.col("title"), F.lit("*."), pub).alias("apa"), F.concat(F.when(inverted != "", F.concat(inverted, F.lit(". "))).otherwise(""), F.lit("*"), F.col("title"), F.lit("*."), pub).alias("mla"))


def _cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared checkpoint folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return df.checkpoint()


def toc_flatten(toc: DataFrame, deepest: int = 32) -> DataFrame:
    """(book_id, node_id, label, depth, breadcrumb) of toc(book_id, node_id, parent_id, ord, label), level by level.

    A recursive query would stop at spark.sql.cteRecursionRowLimit, which holds for the nodes of all books together.
    """
    nodes = _cut(toc.select("book_id", "node_id", "parent_id", "label"))
    level = nodes.where("parent_id is null").select("book_id", "node_id", "label", F.lit(0).cast("long").alias("depth"), F.col("label").alias("breadcrumb"))
    out = level
    child = nodes.where("parent_id is not null").alias("c")
    for depth in range(1, deepest + 1):
        on = F.expr("c.book_id = w.book_id and c.parent_id = w.node_id")
        below = level.alias("w").join(child, on).select("c.book_id", "c.node_id", "c.label", F.lit(depth).cast("long").alias("depth"), F.concat("w.breadcrumb", F.lit(" > "), "c.label").alias("breadcrumb"))
        level = _cut(below)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def code_blocks(sections: DataFrame) -> DataFrame:
    """(book_id, section_index, block_index, language, code) of literal <pre> elements."""
    raw = F.regexp_extract_all("raw_html", F.lit(r"(?s)<pre>.*?</pre>"), F.lit(0))
    each = sections.select("book_id", "section_index", F.posexplode(raw).alias("k", "b"))
    cls = F.regexp_extract("b", r'class="([^"]*)"', 1)
    lang = F.when(cls == "", "text").otherwise(F.regexp_replace(F.split_part(cls, F.lit(" "), F.lit(1)), "^(?:language-|lang-)", ""))
    return each.select("book_id", "section_index", F.col("k").cast("long").alias("block_index"), lang.alias("language"), F.regexp_replace("b", r"<[^>]*+>", "").alias("code"))


def footnotes(sections: DataFrame) -> DataFrame:
    """(book_id, section_index, note_id, note_text): notes that links refer to, then asides that none does."""
    keys = ["book_id", "section_index"]
    refs = sections.select(*keys, F.explode(F.regexp_extract_all("raw_html", F.lit(r'(?s)<a\b[^>]*epub:type="noteref"[^>]*href="#([^"]+)"|<a\b[^>]*href="#([^"]+)"[^>]*epub:type="noteref"'), F.lit(0))).alias("a")).select(*keys, F.regexp_extract("a", r'href="#([^"]+)"', 1).alias("note_id")).distinct()
    notes = sections.select(*keys, F.explode(F.regexp_extract_all("raw_html", F.lit(r"(?s)<(aside|div|p|li)\b[^>]*\bid=\"[^\"]+\"[^>]*>.*?</\1>"), F.lit(0))).alias("x"))
    notes = notes.select(*keys, F.regexp_extract("x", r'\bid="([^"]+)"', 1).alias("note_id"), F.trim(F.regexp_replace(F.regexp_replace("x", r"<[^>]*+>", " "), r"\s+", " ")).alias("note_text"), F.col("x").startswith("<aside").alias("aside"))
    on = [*keys, "note_id"]
    return notes.join(refs, on).drop("aside").unionByName(notes.where("aside").drop("aside").join(refs, on, "left_anti"))


def upsert_annotations(old: DataFrame, new: DataFrame) -> DataFrame:
    """The latest row of each id (new before old); works as a foreachBatch merge."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_age")))
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    return both.withColumn("_r", rank).where("_r = 1").drop("_r", "_age")
