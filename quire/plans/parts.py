"""Queries for the parts of books: package documents, navigation, encryption lists, ranges, covers and resources, each with DuckDB SQL for the
same rows. The documents are put together from the driver's tables, one or more for each of their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import assets
from quire.sources import package, side

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("book_id"), F.col("turn").cast("long").alias("i"), F.coalesce("role", F.lit("")).alias("role"))


def _cat(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _opf(own: Column, lang: Column) -> Column:
    mark = F.when(own % 3 == 0, ' properties="cover-image"').otherwise("")
    guide = F.when(own % 3 == 1, '<guide><reference type="cover" title="C" href="cover.xhtml"/></guide>').otherwise("")
    way = F.when(own % 2 == 0, "rtl").otherwise("other")
    return _cat(
        '<package xmlns="http://www.idpf.org/2007/opf"><metadata><title>Book ', own, "</title><title>", lang, '</title><creator> A &amp; B </creator><creator/><meta name="cover" content="c"/></metadata>',
        '<manifest><item id="s" href="t%201.xhtml" media-type="application/xhtml+xml"/><item id="c" href="../img/c', own, '.png" media-type="image/png"', mark, '/><item id="x" href="x"/></manifest>',
        '<spine toc="ncx" page-progression-direction="', way, '"><itemref idref="gone"/><itemref idref="s" linear="no"/></spine>', guide, "</package>",
    )


_COVER = "case when doc_id % 3 = 1 then 'OEBPS/cover.xhtml' else 'img/c' || doc_id || '.png' end"


@_query(f"""select doc_id book_id, 'Book ' || doc_id || case when trim(coalesce(lang, '')) <> '' then ': ' || trim(lang) else '' end title, ['A & B'] creators, case when doc_id % 2 = 0 then 'rtl' else 'default' end direction,
{_COVER} cover_href, 'ncx' toc_id, 2::bigint n_items, 'OEBPS/t 1.xhtml' first_href, false first_linear, (doc_id % 3 = 1)::bigint n_guide, cast(null as varchar) error from documents""")
def packages(spark, d):  # noqa: ANN001, ANN201
    own = F.col("doc_id")
    rows = package.packages(_docs(spark, d).select(_cat("OEBPS/", own, ".opf").alias("path"), _opf(own, F.col("lang")).alias("text")))
    spine = F.get("spine", F.lit(0))
    return rows.select(F.regexp_extract("path", r"(\d+)\.opf", 1).cast("long").alias("book_id"), "title", "creators", "direction", "cover_href", "toc_id", F.size("manifest").cast("long").alias("n_items"), spine["href"].alias("first_href"), spine["linear"].alias("first_linear"), F.size("guide").cast("long").alias("n_guide"), "error")


_BOTH = "select conv_id book_id, turn::bigint i, coalesce(role, '') r from conversations where trim(coalesce(role, '')) <> ''"
_TOC = f"""with t as ({_BOTH}) select book_id, i, 0 node_id, null::integer parent_id, trim(r) label, 'EPUB/t' || i || '.xhtml' full_path, 0 depth, trim(r) breadcrumb from t
union all select book_id, i, 1, 0, 'Sub ' || i, 'EPUB/u 1.xhtml', 1, trim(r) || ' > Sub ' || i from t"""


def _toc(rows: DataFrame) -> DataFrame:
    name = F.split(F.regexp_replace("path", r"^EPUB/|\.\w+$", ""), "-")
    return rows.select(F.get(name, F.lit(0)).cast("long").alias("book_id"), F.get(name, F.lit(1)).cast("long").alias("i"), "node_id", "parent_id", "label", "full_path", "depth", "breadcrumb")


def _named(turns: DataFrame, kind: str, text: Column) -> DataFrame:
    return turns.where(F.trim("role") != "").select(_cat("EPUB/", F.col("book_id"), "-", F.col("i"), f".{kind}").alias("path"), text.alias("text"))


@_query(_TOC)
def ncx_toc(spark, d):  # noqa: ANN001, ANN201
    i, role = F.col("i"), F.col("role")
    text = _cat('<ncx><navMap><navPoint id="a"><navLabel><text>', role, '</text></navLabel><content src="t', i, '.xhtml#x"/><navPoint><navLabel><text> Sub ', i, ' </text></navLabel><content src="./u%201.xhtml"/></navPoint></navPoint><navPoint id="none"/></navMap></ncx>')
    return _toc(side.toc(_named(_turns(spark, d), "ncx", text)))


_NAV = '<html xmlns:epub="http://www.idpf.org/2007/ops"><body>'


@_query(_TOC)
def nav_toc(spark, d):  # noqa: ANN001, ANN201
    i, role = F.col("i"), F.col("role")
    text = _cat(_NAV, '<nav epub:type="toc"><ol><li><a href="t', i, '.xhtml#x">', role, '</a><ol><li><a href="u%201.xhtml">Sub ', i, "</a></li><li>no link</li></ol></li></ol></nav></body></html>")
    return _toc(side.toc(_named(_turns(spark, d), "xhtml", text)))


@_query("select conv_id book_id, turn::bigint i, unnest(['landmark', 'page']) kind, unnest(['bodymatter', null]) epub_type, unnest(['Start', 'p' || turn]) label, unnest(['t' || turn || '.xhtml', '#p' || turn]) href from conversations")
def nav_lists(spark, d):  # noqa: ANN001, ANN201
    i = F.col("i")
    text = _cat(_NAV, '<nav epub:type="landmarks"><ol><li><a epub:type="bodymatter" href="t', i, '.xhtml">Start</a></li></ol></nav><nav epub:type="page-list"><ol><li><a href="#p', i, '">p', i, "</a></li></ol></nav></body></html>")
    files = _turns(spark, d).select(_cat(F.col("book_id"), "-", i).alias("path"), text.alias("text"))
    rows = side.each(files, lambda text, path: [("landmark", *x) for x in side.landmarks(text)] + [("page", None, *x) for x in side.page_list(text)], "kind string, epub_type string, label string, href string")
    return rows.select(F.substring_index("path", "-", 1).cast("long").alias("book_id"), F.substring_index("path", "-", -1).cast("long").alias("i"), "kind", "epub_type", "label", "href")


@_query("select doc_id book_id, 'OEBPS/f' || doc_id || '.otf' uri, 'http://www.idpf.org/2008/embedding' algorithm from documents")
def encryption_list(spark, d):  # noqa: ANN001, ANN201
    own = F.col("doc_id")
    text = _cat('<encryption><EncryptedData><EncryptionMethod Algorithm="http://www.idpf.org/2008/embedding"/><CipherData><CipherReference URI="OEBPS/f', own, '.otf"/></CipherData></EncryptedData></encryption>')
    rows = side.each(_docs(spark, d).select(own.cast("string").alias("path"), text.alias("text")), lambda text, path: list(side.encryption(text).items()), "uri string, algorithm string")
    return rows.select(F.col("path").cast("long").alias("book_id"), "uri", "algorithm")


@_query("select event_id, event_id * 10 as first, case when event_id % 2 = 0 then event_id * 10 + 9 end as last from events where event_id % 5 <> 0")
def byte_ranges(spark, d):  # noqa: ANN001, ANN201
    e = F.col("event_id")
    head = F.when(e % 5 == 0, _cat("items=", e)).when(e % 2 == 0, _cat("bytes=", e * 10, "-", e * 10 + 9)).otherwise(_cat("bytes=", e * 10, "-"))
    files = spark.read.parquet(f"{d}/events.parquet").select(e.cast("string").alias("path"), head.alias("text"))
    rows = side.each(files, lambda text, path: [x] if (x := side.byte_range(text)) else [], "first long, last long")
    return rows.select(F.col("path").cast("long").alias("event_id"), "first", "last")


@_query("""with h as (select doc_id, md5('Title ' || doc_id) h from documents) select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-'
|| translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) uuid from h""")
def book_uuid(spark, d):  # noqa: ANN001, ANN201
    return _docs(spark, d).select("doc_id", T.book_uuid(_cat("Title ", F.col("doc_id"))).alias("uuid"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Of each conversation a picture, a cover page that shows it, and a style sheet that names it."""
    books = _turns(spark, d).select("book_id").distinct()
    own = F.col("book_id")
    made = [("OPS/img/p 1.png", _cat("picture ", own)), ("OPS/text/cover.xhtml", _cat('<p><IMG alt="" src="../img/p%201.png"/></p>')), ("OPS/css/s.css", _cat("b{background:url( '../img/p%201.png' )} i{src:url(http://x/y.otf)}"))]
    return books.select("book_id", F.inline(F.array(*(F.struct(F.lit(p).alias("path"), c.cast("binary").alias("content")) for p, c in made))))


_PICTURE = "'data:image/png;base64,' || base64(encode('picture ' || conv_id))"


@_query(f"""with b as (select distinct conv_id from conversations), s as (select conv_id, {_PICTURE} p, 'data:text/css;base64,' || base64(encode('b{{background:url("' || {_PICTURE} || '")}} i{{src:url(http://x/y.otf)}}')) c from b)
select conv_id book_id, turn::bigint section_index, '<link rel="stylesheet" href="' || c || '"><img src="' || p || '"><img src="gone.png"><img src="https://x/p.png">t' || turn html,
'<link rel="stylesheet" href="resource/OPS/css/s.css"><img src="resource/OPS/img/p 1.png"><img src="resource/OPS/text/gone.png"><img src="https://x/p.png">t' || turn streamed from conversations join s using (conv_id)""")
def inline_assets(spark, d):  # noqa: ANN001, ANN201
    html = _cat('<link rel="stylesheet" href="../css/s.css"><img src="../img/p%201.png"><img src="gone.png"><img src="https://x/p.png">t', F.col("i"))
    sections = _turns(spark, d).select("book_id", F.col("i").alias("section_index"), F.lit("OPS/text/c.xhtml").alias("href"), html.alias("raw_html"))
    rows = assets.inlined(sections, _members(spark, d))
    return rows.select("book_id", "section_index", "html", assets.streamed(F.col("raw_html"), F.col("href")).alias("streamed"))


@_query("""select distinct conv_id book_id, case conv_id % 3 when 2 then null else 'OPS/img/p 1.png' end cover_path, case conv_id % 3 when 2 then null else 'image/png' end mime,
case conv_id % 3 when 2 then null else 'picture ' || conv_id end as text from conversations""")
def cover_image(spark, d):  # noqa: ANN001, ANN201
    own = F.col("book_id")
    books = _turns(spark, d).select("book_id").distinct().withColumn("cover_href", F.when(own % 3 == 0, "OPS/img/p 1.png").when(own % 3 == 1, "OPS/text/cover.xhtml").otherwise("OPS/none.png"))
    return assets.covers(books, _members(spark, d)).select("book_id", "cover_path", "mime", F.col("content").cast("string").alias("text"))


@_query("select distinct conv_id book_id, 'resource/OPS/css/s.css' path, 'text/css' mime, length('b{background:url( ''../img/p%201.png'' )} i{src:url(http://x/y.otf)}')::bigint n_bytes from conversations")
def resource_fetch(spark, d):  # noqa: ANN001, ANN201
    books = _turns(spark, d).select("book_id").distinct()
    wanted = books.select("book_id", F.explode(F.array(F.lit("resource/OPS/css/s.css"), F.lit("gone"))).alias("path"))
    return assets.fetched(_members(spark, d), wanted).select("book_id", "path", "mime", F.octet_length("content").cast("long").alias("n_bytes"))
