"""Lookups and exports over books: locations, locators, tables of contents, overlays, annotations, citations, duplicates by metadata, code lines,
rendering and layout. All are joins and built-in expressions; see quire.operators.books for the tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import markup as M
from quire.functions import text as T
from quire.operators import books as B


def _sizes(sections: DataFrame, chunk: int) -> DataFrame:
    """(book_id, section_index, n, rows, before, total) of each section: its locations, those before it, those of the book."""
    n = F.length("plain_text")
    rows = F.greatest(F.ceil(n / chunk), F.lit(1)).cast("long")
    of_book = Window.partitionBy("book_id")
    before = F.coalesce(F.sum(rows).over(of_book.orderBy("section_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sections.select("book_id", "section_index", n.alias("n"), rows.alias("rows"), before.alias("before"), F.sum(rows).over(of_book).alias("total"))


def location_lookup(sections: DataFrame, at: DataFrame, chunk: int = 1024) -> DataFrame:
    """at(book_id, section_index, char_offset) with location, char_start, char_end and percentage (of the book's locations).

    An offset between two locations belongs to the earlier one; one past the section's end to the section's first location. Found
    by arithmetic: no range join. Places in sections that the book has not are left out.
    """
    off = F.col("char_offset")
    k = F.when((off <= 0) | (off > F.col("n")), 0).otherwise(F.greatest(F.ceil(off / chunk) - 1, F.lit(0))).cast("long")
    found = at.join(_sizes(sections, chunk), ["book_id", "section_index"])
    location = F.col("before") + k + 1
    return found.select(*at.columns, location.alias("location"), (k * chunk).alias("char_start"), F.least((k + 1) * chunk, F.col("n")).cast("long").alias("char_end"), F.least(F.greatest(location / F.col("total"), F.lit(0.0)), F.lit(1.0)).alias("percentage"))


def cfi_lookup(sections: DataFrame, at: DataFrame, chunk: int = 1024) -> DataFrame:
    """at(book_id, cfi) with section_index, char_offset and what location_lookup() gives."""
    return location_lookup(sections, at.withColumn("section_index", T.cfi_spine_index(F.col("cfi"))).withColumn("char_offset", T.cfi_char_offset(F.col("cfi"))), chunk)


def cfi_of_location(locations: DataFrame) -> DataFrame:
    """(book_id, location, cfi) of locations()."""
    return locations.select("book_id", "location", T.cfi(F.col("spine_index"), F.lit(""), F.col("char_start")).alias("cfi"))


def locators(sections: DataFrame, at: DataFrame, chunk: int = 1024) -> DataFrame:
    """Reading-system locators of at(book_id, section_index, char_offset): href, type, title, cfi, fragment, position, progression, totalProgression, highlight."""
    found = location_lookup(sections, at, chunk)
    cols = ["book_id", "section_index", "href", "plain_text", *(["raw_html"] if "raw_html" in sections.columns else [])]
    both = found.join(sections.select(*cols), ["book_id", "section_index"])
    fragment = M.nearest_anchor(F.col("raw_html"), F.col("char_offset")) if "raw_html" in cols else F.lit(None).cast("string")
    part = F.least(F.greatest(F.col("char_offset") / F.greatest(F.length("plain_text"), F.lit(1)), F.lit(0.0)), F.lit(1.0))
    return both.select(
        "book_id", "section_index", "char_offset", "href", F.lit("application/xhtml+xml").alias("type"), F.concat(F.lit("Section "), (F.col("section_index") + 1).cast("string")).alias("title"),
        T.cfi(F.col("section_index"), F.lit(""), F.col("char_offset")).alias("cfi"), fragment.alias("fragment"), F.col("location").alias("position"), part.alias("progression"), F.col("percentage").alias("totalProgression"),
        F.substring("plain_text", (F.col("char_offset") + 1).cast("int"), F.lit(100)).alias("highlight"),
    )


def toc_search(flat: DataFrame, query: str) -> DataFrame:
    """Nodes of toc_flatten() whose label holds the query, whatever its case; a blank query has none."""
    return flat.where(F.lower("label").contains(query.lower())) if query.strip() else flat.limit(0)


def _file(href: Column) -> Column:
    return F.substring_index(F.split_part(href, F.lit("#"), F.lit(1)), "/", -1)


def toc_labels(sections: DataFrame, toc: DataFrame) -> DataFrame:
    """sections with chapter: the label of the first top-level node of toc(book_id, ord, depth, label, href) that leads to the section's file, else "Section n"."""
    first = toc.where("depth = 0").groupBy("book_id", _file(F.col("href")).alias("file")).agg(F.min_by("label", "ord").alias("chapter"))
    both = sections.withColumn("file", _file(F.col("href"))).join(first, ["book_id", "file"], "left")
    return both.select(*sections.columns, F.coalesce("chapter", F.concat(F.lit("Section "), (F.col("section_index") + 1).cast("string"))).alias("chapter"))


def toc_targets(toc: DataFrame, sections: DataFrame) -> DataFrame:
    """toc with section_index: the first section of the node's file, else the book's first section."""
    by_file = sections.groupBy("book_id", _file(F.col("href")).alias("file")).agg(F.min("section_index").alias("own"))
    firsts = sections.groupBy("book_id").agg(F.min("section_index").alias("any"))
    both = toc.withColumn("file", _file(F.col("href"))).join(by_file, ["book_id", "file"], "left").join(firsts, "book_id", "left")
    return both.select(*toc.columns, F.coalesce("own", "any").alias("section_index"))


def section_by_href(sections: DataFrame, href: str) -> DataFrame:
    """Of each book the first section whose href is this one, or ends with /href; a #fragment is left out."""
    bare = href.split("#")[0]
    hit = sections.where((F.col("href") == bare) | F.col("href").endswith("/" + bare))
    return hit.join(hit.groupBy("book_id").agg(F.min("section_index").alias("section_index")), ["book_id", "section_index"]).select(sections.columns)


def section_by_cfi(sections: DataFrame, at: DataFrame) -> DataFrame:
    """The sections that at(book_id, cfi) point to."""
    return sections.join(at.select("book_id", T.cfi_spine_index(F.col("cfi")).alias("section_index")), ["book_id", "section_index"], "left_semi")


def audio_of_text(overlays: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(book_id, href) with the first clip whose text is that source, path, or element: exploded keys and one equi-join."""
    keys = F.array_compact(F.array("text_src", "text_path", "element_id", F.substring_index("text_src", "/", -1)))
    keyed = overlays.select("book_id", F.explode(F.array_distinct(keys)).alias("href"), F.struct("seq", "ord").alias("o"), F.struct("audio_src", "audio_path", "clip_begin", "clip_end").alias("c"))
    first = keyed.groupBy("book_id", "href").agg(F.min_by("c", "o").alias("c"))
    return wanted.withColumn("href", F.trim("href")).join(first, ["book_id", "href"]).select(*wanted.columns, "c.*")


def text_at_time(overlays: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(book_id, audio, seconds) with the first text whose clip of that source or path holds the time; a clip without an end stays open."""
    keyed = overlays.select("book_id", F.explode(F.array_distinct(F.array_compact(F.array("audio_src", "audio_path", F.substring_index("audio_src", "/", -1))))).alias("audio"), "clip_begin", "clip_end", F.struct("seq", "ord").alias("o"), F.struct("text_src", "text_path", "element_id").alias("t"))
    hit = wanted.withColumn("audio", F.trim("audio")).join(keyed, ["book_id", "audio"]).where("seconds >= clip_begin and (clip_end <= 0 or seconds <= clip_end)")
    return hit.groupBy(*wanted.columns).agg(F.min_by("t", "o").alias("t")).select(*wanted.columns, "t.*")


def w3c_annotations(annotations: DataFrame) -> DataFrame:
    """(id, json) of annotations(id, type, cfi_range, note, created_at) in the Web Annotation model."""
    why = F.create_map(*(F.lit(x) for pair in (("highlight", "highlighting"), ("bookmark", "bookmarking"), ("underline", "underlining"), ("note", "commenting")) for x in pair))
    s = F.struct(
        F.lit("http://www.w3.org/ns/anno.jsonld").alias("@context"), F.concat(F.lit("urn:annotation:"), "id").alias("id"), F.lit("Annotation").alias("type"), F.try_element_at(why, F.lower("type")).alias("motivation"),
        F.struct(F.struct(F.lit("FragmentSelector").alias("type"), F.lit("http://www.idpf.org/epub/linking/cfi/epub-cfi.html").alias("conformsTo"), F.col("cfi_range").alias("value")).alias("selector")).alias("target"),
        F.struct(F.lit("TextualBody").alias("type"), F.coalesce("note", F.lit("")).alias("value"), F.lit("text/plain").alias("format")).alias("body"), F.col("created_at").alias("created"),
    )
    return annotations.select("id", F.to_json(s).alias("json"))


def search_json(hits: DataFrame, query: str) -> DataFrame:
    """(book_id, json): the hits of a book as a search result document, in their order."""
    one = F.struct(F.format_string("section_%d.html", "spine_index").alias("href"), F.lit("application/xhtml+xml").alias("type"), F.struct("cfi", (F.floor(F.col("char_offset") / 1000) + 1).alias("position")).alias("locations"), F.struct("snippet").alias("text"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("spine_index", "char_offset", one.alias("l")))), lambda x: x["l"])
    both = hits.groupBy("book_id").agg(ordered.alias("locators"), F.count("*").alias("n"))
    return both.select("book_id", F.to_json(F.struct(F.lit("http://readium.org/webpub-manifest/context.jsonld").alias("@context"), F.struct(F.col("n").alias("numberOfResults"), F.lit(query).alias("query")).alias("metadata"), "locators")).alias("json"))


def webpub_manifest(books: DataFrame, spine: DataFrame, toc: DataFrame) -> DataFrame:
    """(book_id, json) of books(book_id, title, creators, publisher, languages, direction), spine(book_id, spine_index, href, media_type) and two levels of toc."""
    xhtml = F.lit("application/xhtml+xml").alias("type")
    item = F.struct("href", F.when(F.coalesce("media_type", F.lit("")) == "", "application/xhtml+xml").otherwise(F.col("media_type")).alias("type"), F.concat(F.lit("Section "), (F.col("spine_index") + 1).cast("string")).alias("title"))
    listed = lambda x: F.transform(F.sort_array(F.collect_list(x)), lambda y: y["x"])
    order = spine.groupBy("book_id").agg(listed(F.struct("spine_index", item.alias("x"))).alias("readingOrder"))
    below = toc.where("depth = 1").groupBy("book_id", F.col("parent_id").alias("node_id")).agg(listed(F.struct("ord", F.struct("href", xhtml, F.col("label").alias("title")).alias("x"))).alias("children"))
    top = toc.where("depth = 0").join(below, ["book_id", "node_id"], "left")
    top = top.groupBy("book_id").agg(listed(F.struct("ord", F.struct("href", xhtml, F.col("label").alias("title"), "children").alias("x"))).alias("toc"))
    meta = F.struct(F.lit("http://schema.org/Book").alias("@type"), "title", F.col("creators").alias("author"), "publisher", F.col("languages").alias("language"), F.when(F.col("direction") == "rtl", "rtl").otherwise("ltr").alias("readingProgression"))
    links = F.array(F.struct(F.lit("manifest.json").alias("href"), F.lit("application/webpub+json").alias("type"), F.lit("self").alias("rel")))
    whole = books.join(order, "book_id", "left").join(top, "book_id", "left")
    return whole.select("book_id", F.to_json(F.struct(F.lit("https://readium.org/webpub-manifest/context.jsonld").alias("@context"), meta.alias("metadata"), links.alias("links"), "readingOrder", "toc")).alias("json"))


def more_citations(books: DataFrame) -> DataFrame:
    """(book_id, bibtex, chicago) of books(book_id, title, creator, publisher, pub_date, language, identifier)."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    or_ = lambda c, d: F.when(has(c), F.col(c)).otherwise(d)
    year = B.year(F.col("pub_date"))
    line = lambda name, value: F.concat(F.lit(f"  {name:<9} = {{"), value, F.lit("}"))
    key = B.citations(books).select("book_id", "cite_key")
    lines = F.array_compact(F.array(line("title", or_("title", "Untitled")), line("author", or_("creator", "Unknown Author")), line("publisher", F.coalesce("publisher", F.lit("Self-Published"))), F.when(year.isNotNull(), line("year", year)), F.when(has("language"), line("language", F.col("language"))), F.when(F.col("identifier").isNotNull(), line("isbn", F.col("identifier")))))
    names = F.filter(F.split(F.coalesce("creator", F.lit("")), r"\s+"), lambda x: x != "")
    inverted = F.when(~has("creator"), "Unknown Author").when(F.size(names) > 1, F.concat(F.element_at(names, -1), F.lit(", "), F.array_join(F.slice(names, F.lit(1), F.size(names) - 1), " "))).otherwise(F.col("creator"))
    chicago = F.concat(inverted, F.lit(". *"), or_("title", "Untitled"), F.lit("*. N.p.: "), F.coalesce("publisher", F.lit("n.p.")), F.lit(", "), F.coalesce(year, F.lit("n.d.")), F.lit("."))
    return books.join(key, "book_id").select("book_id", F.concat(F.lit("@book{"), "cite_key", F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}")).alias("bibtex"), chicago.alias("chicago"))


def section_faults(sections: DataFrame) -> DataFrame:
    """(book_id, code, severity, location) of sections without an address, or without text and HTML."""
    html = F.col("raw_html") if "raw_html" in sections.columns else F.col("plain_text")
    empty = (F.length("plain_text") == 0) & (F.trim(F.coalesce(html, F.lit(""))) == "")
    rules = [("RSC-003", "Error", F.trim(F.coalesce("href", F.lit(""))) == ""), ("RSC-004", "Warning", empty)]
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, test in rules)))
    return sections.select("book_id", F.format_string("sections[%d]", F.col("section_index").cast("long")).alias("location"), F.inline(found)).select("book_id", "code", "severity", "location")


def fault_counts(books: DataFrame, faults: DataFrame) -> DataFrame:
    """(book_id, errors, warnings, infos, is_valid) of every book, faults having book_id and severity."""
    n = lambda s: F.count_if(F.col("severity") == s)
    per = faults.groupBy("book_id").agg(n("Error").alias("errors"), n("Warning").alias("warnings"), n("Info").alias("infos"))
    of = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return books.select("book_id").join(per, "book_id", "left").select("book_id", of("errors"), of("warnings"), of("infos"), (F.coalesce("errors", F.lit(0)) == 0).alias("is_valid"))


def metadata_duplicates(prints: DataFrame, least: float = 0.85) -> DataFrame:
    """(book_id, leader) of books(book_id, metadata_hash, total_sections, total_characters) that are alike by equal metadata and section count.

    Two such books score 0.6 + 0.4 * (smaller / larger size); so, sorted by size, each run of neighbours within that share is connected,
    and no pairs are made. leader: the run's smallest book_id. Books without text, and those alone, give no row.
    """
    share = (least - 0.6) / 0.4
    block = Window.partitionBy("metadata_hash", "total_sections").orderBy("total_characters", "book_id")
    some = prints.where("total_characters > 0").withColumn("breaks", (F.coalesce(F.lag("total_characters").over(block) / F.col("total_characters"), F.lit(0.0)) < share).cast("int"))
    runs = some.withColumn("run", F.sum("breaks").over(block.rowsBetween(Window.unboundedPreceding, 0)))
    keys = ["metadata_hash", "total_sections", "run"]
    lead = runs.groupBy(*keys).agg(F.min("book_id").alias("leader"), F.count("*").alias("c")).where("c > 1")
    return runs.join(lead, keys).select("book_id", "leader")


def code_lines(blocks: DataFrame) -> DataFrame:
    """blocks(..., code) as one row for each line that begins a function, a type or a comment: kind, start_byte, end_byte, row; a block without any is a source_file."""
    t = lambda x: F.trim(x)
    starts = lambda x, words: F.exists(F.array(*map(F.lit, words)), lambda w: t(x).startswith(w))
    kind = lambda x: F.when(starts(x, ["fn ", "def ", "function ", "pub fn "]), "function_definition").when(starts(x, ["//", "#", "/*"]), "comment").when(starts(x, ["struct ", "class ", "enum ", "type "]), "type_definition")
    lines = F.split(F.regexp_replace("code", r"\n\z", ""), "\n", -1)
    ends = F.aggregate(F.transform(lines, lambda x: F.octet_length(x) + 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["all"], a["at"] + n).alias("all")))["all"]
    found = F.filter(F.zip_with(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), ends, lambda y, e: F.struct(kind(y["x"]).alias("kind"), (e - 1 - F.octet_length(y["x"])).alias("start_byte"), (e - 1).alias("end_byte"), y["i"].alias("row"))), lambda x: x["kind"].isNotNull())
    whole = F.array(F.struct(F.lit("source_file").alias("kind"), F.lit(0).alias("start_byte"), F.octet_length("code").alias("end_byte"), F.lit(0).alias("row")))
    return blocks.select(*blocks.columns, F.inline(F.when(F.size(found) > 0, found).otherwise(whole))).drop("code")


def rendered(sections: DataFrame, hooks: tuple[Callable[[Column], Column], ...] = ()) -> DataFrame:
    """sections(..., raw_html, direction) with html: set right to left where the book is, sanitised, then passed through the hooks in their order."""
    html = F.when(F.col("direction") == "rtl", M.right_to_left(F.col("raw_html"))).otherwise(F.col("raw_html")) if "direction" in sections.columns else F.col("raw_html")
    html = M.sanitized(html)
    for hook in hooks:
        html = hook(html)
    return sections.withColumn("html", html)


def spreads(sections: DataFrame, width: float = 600.0, height: float = 800.0) -> DataFrame:
    """(book_id, left_index, right_index, left_html, right_html, width, height): pages 0 and 1, 2 and 3 and so on side by side."""
    own = sections.withColumn("pair", F.floor(F.col("section_index") / 2))
    side = lambda k, name: F.max(F.when(F.col("section_index") % 2 == k, F.struct("section_index", "raw_html", F.coalesce("viewport_width", F.lit(width)).alias("w"), F.coalesce("viewport_height", F.lit(height)).alias("h")))).alias(name)
    both = own.groupBy("book_id", "pair").agg(side(0, "l"), side(1, "r"))
    return both.select("book_id", F.col("l.section_index").alias("left_index"), F.col("r.section_index").alias("right_index"), F.col("l.raw_html").alias("left_html"), F.col("r.raw_html").alias("right_html"), F.col("l.w").alias("width"), F.col("l.h").alias("height"))


def scale(content_width: Column, content_height: Column, width: Column, height: Column) -> Column:
    """The largest scale at which fixed content fits a window; null unless all sizes are positive."""
    return F.when((content_width > 0) & (content_height > 0) & (width > 0) & (height > 0), F.least(width / content_width, height / content_height))


#: Background, text and link colours of the themes.
THEMES = {"light": ("#ffffff", "#1e293b", "#2563eb"), "dark": ("#0f172a", "#f8fafc", "#60a5fa"), "sepia": ("#fef3c7", "#451a03", "#b45309"), "solarized": ("#073642", "#839496", "#268bd2"), "high_contrast": ("#000000", "#ffffff", "#ffff00")}


@dataclass(frozen=True)
class Rendition:
    """Parameters of a reader's style."""

    theme: str = "light"
    font_family: str = "serif"
    font_size: int = 16
    line_height: float = 1.6
    margin: int = 32
    writing_mode: str = "horizontal-ltr"
    custom_font: tuple[str, str] | None = None

    def css(self) -> str:
        back, text, link = THEMES[self.theme]
        face = f"@font-face {{ font-family: '{self.custom_font[0]}'; src: url('{self.custom_font[1]}'); }}\n" if self.custom_font else ""
        mode = f"direction: {self.writing_mode[-3:]};" if self.writing_mode.startswith("horizontal") else f"writing-mode: {self.writing_mode}; -webkit-writing-mode: {self.writing_mode};"
        family = self.custom_font[0] if self.custom_font else self.font_family
        body = f"background-color: var(--reader-bg) !important; color: var(--reader-fg) !important; font-family: {family} !important; font-size: {self.font_size}px !important; line-height: {self.line_height} !important; padding: {self.margin}px !important; {mode}"
        return f"{face}:root {{ --reader-bg: {back}; --reader-fg: {text}; --reader-link: {link}; }}\nbody {{ {body} }}\na {{ color: var(--reader-link) !important; }}"


def expired(end: Column, now: Column) -> Column:
    """Whether a licence's end lies before now; a date alone means its first (now) or last (end) second. Without an end: no."""
    clean = lambda x, rest: F.when(F.length(F.rtrim(F.trim(x), F.lit("Z"))) == 10, F.concat(F.rtrim(F.trim(x), F.lit("Z")), F.lit(rest))).otherwise(F.rtrim(F.trim(x), F.lit("Z")))
    return F.coalesce(clean(now, "T00:00:00") > clean(end, "T23:59:59"), F.lit(False))


def download_link(links: Column, mime: str = "application/epub+zip") -> Column:
    """The first link of that type, or of an acquisition relation."""
    return F.get(F.filter(links, lambda x: (x["type"] == mime) | x["rel"].contains("acquisition")), F.lit(0))


#: A licence's JSON.
LICENCE = "id string, provider string, issued string, updated string, user struct<id:string,email:string,name:string>, rights struct<print:long,copy:long,start:string,end:string>, encryption struct<profile:string,user_key:struct<text_hint:string,algorithm:string,key_check:string>>"


def licences(text: Column) -> Column:
    return F.from_json(text, LICENCE)


def screen_reader_friendly(modes: Column, features: Column) -> Column:
    return F.array_contains(modes, "textual") & F.exists(features, lambda f: f.contains("structuralNavigation") | f.contains("tableOfContents"))


def has_alternative_text(features: Column) -> Column:
    return F.exists(features, lambda f: f.contains("alternativeText"))


def save_cache(df: DataFrame, path: str) -> None:
    """A canonical table as zstd Parquet; spark.read.parquet restores it."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
