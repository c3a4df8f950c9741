"""Resources of books: fetching, covers, and images, styles and fonts put into the sections that name them.

resources(book_id, path, content) holds the members of all books. References are taken out of the text, joined by (book_id, path) and put back,
so no book's resources are ever held together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

_TAG = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _lossy(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def _base64(content: Column) -> Column:
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def data_uri(path: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), T.mime_type(path), F.lit(";base64,"), _base64(content))


def fetched(resources: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(book_id, path) with mime and content; a leading resource/ of the path does not count. What no book has is left out."""
    named = wanted.select("book_id", F.col("path").alias("asked"), F.regexp_replace("path", "^resource/", "").alias("path"))
    return named.join(resources.select("book_id", "path", "content"), ["book_id", "path"]).select("book_id", F.col("asked").alias("path"), T.mime_type(F.col("path")).alias("mime"), "content")


def covers(packages: DataFrame, resources: DataFrame) -> DataFrame:
    """packages(book_id, cover_href) with cover_path, mime and content: the image itself, or the first image of a cover page; else nulls."""
    held = resources.select("book_id", "path", "content")
    kind = T.mime_type(F.col("cover_href"))
    pages = held.where(T.mime_type(F.col("path")) == "application/xhtml+xml").select("book_id", F.col("path").alias("cover_href"), _lossy(F.col("content")).alias("page"))
    src = F.concat(*(F.regexp_extract("page", r"(?is)<img.*?src=(?:\"([^\"]*)\"|'([^']*)')", k) for k in (1, 2)))
    path = F.when(kind.startswith("image/"), F.col("cover_href")).when(src != "", T.resolve_path(_folder(F.col("cover_href")), src))
    at = packages.join(pages, ["book_id", "cover_href"], "left").withColumn("path", path).drop("page")
    found = at.join(held, ["book_id", "path"], "left").withColumn("cover_path", F.when(F.col("content").isNotNull(), F.col("path")))
    return found.withColumn("mime", T.mime_type(F.col("cover_path"))).withColumn("mime", F.when(F.col("cover_path").isNotNull(), F.col("mime"))).drop("path")


def _sources(html: Column) -> Column:
    """(orig, value) of the src attributes that are not addresses of their own."""
    found = F.transform(F.regexp_extract_all(html, F.lit(r'(?i)[ <](src="[^"]*")'), F.lit(1)), lambda x: F.struct(x.alias("orig"), F.regexp_extract(x, '="([^"]*)"', 1).alias("value")))
    return F.filter(found, lambda x: ~x["value"].rlike("^(data:|https?://)"))


def _styles(html: Column) -> Column:
    """(orig, value) of the addresses of linked style sheets."""
    links = F.filter(F.regexp_extract_all(html, F.lit(f"(?i)<link{_TAG}>"), F.lit(0)), lambda x: x.rlike(r'(?i)[ <]href=("[^"]*\.css|\'[^\']*\.css)|rel="stylesheet"'))
    attr = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, '(?i)[ <](href="[^"]*")', 1), F.lit("")), F.regexp_extract(x, "(?i)[ <](href='[^']*')", 1))
    return F.filter(F.transform(links, lambda x: F.struct(attr(x).alias("orig"), F.regexp_extract(attr(x), "=.(.*).$", 1).alias("value"))), lambda x: x["orig"] != "")


def _put(text: Column, made: Column) -> Column:
    """text with each (orig, now) put in, in the order of the array."""
    return F.when(made.isNull(), text).otherwise(F.aggregate(made, text, lambda a, x: F.replace(a, x["orig"], x["now"])))


def streamed(html: Column, href: Column) -> Column:
    """HTML whose resources are addressed as resource/path."""
    base = _folder(href)
    of = lambda found, name: F.transform(found, lambda x: F.struct(x["orig"].alias("orig"), F.concat(F.lit(f'{name}="resource/'), T.resolve_path(base, x["value"]), F.lit('"')).alias("now")))
    return _put(html, F.array_distinct(F.concat(of(_sources(html), "src"), of(_styles(html), "href"))))


def _joined(rows: DataFrame, keys: list[str], refs: Column, base: Column, uris: DataFrame, now: Column) -> DataFrame:
    """keys with made, the (orig, now) of each reference that a resource answers."""
    each = rows.select(*keys, base.alias("_base"), F.explode(F.array_distinct(refs)).alias("x"))
    each = each.select(*keys, F.col("x.orig").alias("orig"), T.resolve_path(F.col("_base"), F.col("x.value")).alias("_at"))
    met = each.join(uris.select(F.col("book_id"), F.col("path").alias("_at"), "uri"), ["book_id", "_at"])
    return met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("orig", now.alias("now")))).alias("made"))


def inlined(sections: DataFrame, resources: DataFrame) -> DataFrame:
    """sections(book_id, section_index, href, raw_html) with html: images and styles as data addresses, and what styles name within these.

    References that no resource answers stay as they are. (book_id, section_index) names a section, (book_id, path) a resource.
    """
    held = resources.select("book_id", "path", "content")
    sheets = held.where(F.lower("path").endswith(".css")).select("book_id", F.col("path").alias("sheet"), _lossy(F.col("content")).alias("css"))
    inner = F.transform(F.regexp_extract_all("css", F.lit(r"url\([^)]*\)"), F.lit(0)), lambda x: F.struct(x.alias("orig"), F.regexp_replace(F.regexp_extract(x, r"(?s)^url\((.*)\)$", 1), r"""^\s*'*"*|"*'*\s*$""", "").alias("value")))
    inner = F.filter(inner, lambda x: ~x["value"].rlike("^(data:|http)"))
    plain = held.withColumn("uri", data_uri(F.col("path"), F.col("content")))
    made = _joined(sheets, ["book_id", "sheet"], inner, _folder(F.col("sheet")), plain, F.concat(F.lit('url("'), F.col("uri"), F.lit('")')))
    whole = sheets.join(made, ["book_id", "sheet"], "left")
    styles = whole.select("book_id", F.col("sheet").alias("path"), F.concat(F.lit("data:text/css;base64,"), _base64(_put(F.col("css"), F.col("made")).cast("binary"))).alias("uri"), F.lit("href").alias("kind"))
    uris = plain.select("book_id", "path", "uri", F.lit("src").alias("kind")).unionByName(styles)

    html = F.col("raw_html")
    of = lambda found, name: F.transform(found, lambda x: F.struct(x["orig"].alias("orig"), x["value"].alias("value"), F.lit(name).alias("kind")))
    refs = sections.select("book_id", "section_index", _folder(F.col("href")).alias("base"), F.explode(F.array_distinct(F.concat(of(_sources(html), "src"), of(_styles(html), "href")))).alias("x"))
    refs = refs.select("book_id", "section_index", F.col("x.orig").alias("orig"), F.col("x.kind").alias("kind"), T.resolve_path(F.col("base"), F.col("x.value")).alias("path"))
    met = refs.join(uris, ["book_id", "path", "kind"]).groupBy("book_id", "section_index").agg(F.array_sort(F.collect_list(F.struct("orig", F.concat("kind", F.lit('="'), "uri", F.lit('"')).alias("now")))).alias("_made"))
    return sections.join(met, ["book_id", "section_index"], "left").withColumn("html", _put(html, F.col("_made"))).drop("_made")
