"""Further queries over the driver's tables: lookups, side documents and exports, each with DuckDB SQL for the same rows.

Conversations are books whose turns are sections. Side documents (catalogues, overlays, HTML with notes and code) are put together from the tables' rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import markup as M
from quire.functions import text as T
from quire.operators import books as B
from quire.operators import reading as R
from quire.sources import side

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _conv(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("book_id"), F.col("turn").cast("long").alias("section_index"), F.concat(F.lit("turn-"), F.col("turn").cast("string")).alias("href"), F.coalesce("text", F.lit("")).alias("plain_text"))


def _half(conv: DataFrame) -> DataFrame:
    return conv.select("book_id", "section_index", F.floor(F.length("plain_text") / 2).alias("char_offset"))


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_C = "(select conv_id book_id, turn::bigint si, 'turn-' || turn href, coalesce(text, '') t from conversations)"
_LOCATED = f"""n as (select *, length(t) n, length(t) // 2 o, greatest(ceil(length(t) / 256.0), 1)::bigint r from {_C}),
w as (select *, (sum(r) over (partition by book_id order by si) - r)::bigint b, sum(r) over (partition by book_id) total from n),
l as (select *, case when o <= 0 then 0 else greatest(ceil(o / 256.0) - 1, 0) end::bigint k from w)"""


@_query(f"with {_LOCATED} select book_id, si section_index, o::bigint char_offset, b + k + 1 as location, k * 256 char_start, least((k + 1) * 256, n)::bigint char_end, (b + k + 1)::double / total::double percentage from l")
def location_lookup(spark, d):  # noqa: ANN001, ANN201
    conv = _conv(spark, d)
    return R.location_lookup(conv, _half(conv), 256)


@_query(f"with {_LOCATED} select book_id, 'epubcfi(/6/' || (2 * (si + 1)) || '!/4/2/1:' || o || ')' cfi, b + k + 1 as location, (b + k + 1)::double / total::double progress from l")
def progress(spark, d):  # noqa: ANN001, ANN201
    conv = _conv(spark, d)
    at = _half(conv).select("book_id", T.cfi(F.col("section_index"), F.lit(""), F.col("char_offset")).alias("cfi"))
    return R.cfi_lookup(conv, at, 256).select("book_id", "cfi", "location", F.col("percentage").alias("progress"))


@_query(f"""with {_LOCATED} select book_id, si section_index, href, 'Section ' || (si + 1) title, 'epubcfi(/6/' || (2 * (si + 1)) || '!/4/2/1:' || o || ')' cfi, b + k + 1 as position,
o::double / greatest(n, 1)::double progression, (b + k + 1)::double / total::double total_progression, substr(t, o + 1, 100) highlight from l""")
def readium_locator(spark, d):  # noqa: ANN001, ANN201
    conv = _conv(spark, d)
    return R.locators(conv, _half(conv), 256).select("book_id", "section_index", "href", "title", "cfi", "position", "progression", F.col("totalProgression").alias("total_progression"), "highlight")


@_query("select conv_id book_id, turn::bigint spine_index, length(text) // 3 char_offset, row_number() over (partition by conv_id order by turn, length(text) // 3)::bigint rank from conversations")
def cfi_order(spark, d):  # noqa: ANN001, ANN201
    from pyspark.sql import Window

    cfi = _conv(spark, d).select("book_id", T.cfi(F.col("section_index"), F.col("href"), F.floor(F.length("plain_text") / 3)).alias("cfi"))
    at = cfi.select("book_id", T.cfi_spine_index(F.col("cfi")).alias("spine_index"), T.cfi_char_offset(F.col("cfi")).alias("char_offset"))
    return at.withColumn("rank", F.row_number().over(Window.partitionBy("book_id").orderBy("spine_index", "char_offset")).cast("long"))


@_query("select conv_id book_id, turn::bigint si, unnest([6, 2 * (turn + 1), 4, 2, 1])::bigint step, unnest([null, 'turn-' || turn, null, null, null]) id, unnest([false, true, false, false, false]) indirect from conversations")
def cfi_parse(spark, d):  # noqa: ANN001, ANN201
    cfi = _conv(spark, d).select("book_id", F.col("section_index").alias("si"), T.cfi(F.col("section_index"), F.col("href"), F.lit(7)).alias("cfi"))
    return cfi.select("book_id", "si", F.inline(T.cfi_steps(F.col("cfi"))))


@_query(f"""select book_id, si, 'epubcfi(/6/' || (2 * (si + 1)) || '[' || href || ']!/4/2/1:3)' range_start, 'epubcfi(/6/' || (2 * (si + 1)) || '[' || href || ']!/4/2/1/2:' || length(t) || ')' range_end,
true is_range, href as element, '#' || href || ' > *:nth-child(2) > *:nth-child(1)' selector from {_C}""")
def cfi_ranges(spark, d):  # noqa: ANN001, ANN201
    conv = _conv(spark, d)
    path = F.concat(F.lit("epubcfi(/6/"), ((F.col("section_index") + 1) * 2).cast("string"), F.lit("["), F.col("href"), F.lit("]!/4/2/1,:3,/2:"), F.length("plain_text").cast("string"), F.lit(")"))
    made = conv.select("book_id", F.col("section_index").cast("long").alias("si"), path.alias("cfi"))
    cfi = F.col("cfi")
    return made.select("book_id", "si", T.cfi_point(cfi).alias("range_start"), T.cfi_point(cfi, 2).alias("range_end"), T.cfi_is_range(cfi).alias("is_range"), T.cfi_element(cfi).alias("element"), T.cfi_selector(cfi).alias("selector"))


@_query("""with t as (select conv_id book_id, turn::bigint node_id, role label from conversations),
f as (select book_id, node_id, label, node_id depth, string_agg(label, ' > ') over (partition by book_id order by node_id) breadcrumb from t)
select * from f where contains(lower(label), 'user')""")
def toc_search(spark, d):  # noqa: ANN001, ANN201
    toc = _table(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").cast("long").alias("node_id"), F.when(F.col("turn") > 0, F.col("turn") - 1).cast("long").alias("parent_id"), F.lit(0).alias("ord"), F.col("role").alias("label"))
    return R.toc_search(B.toc_flatten(toc), "USER")


@_query("select conv_id book_id, turn::bigint section_index, case when turn % 2 = 0 then role else 'Section ' || (turn + 1) end chapter from conversations")
def toc_labels(spark, d):  # noqa: ANN001, ANN201
    toc = _table(spark, d, "conversations").where("turn % 2 = 0").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("ord"), F.lit(0).alias("depth"), F.col("role").alias("label"), F.concat(F.lit("text/turn-"), F.col("turn").cast("string"), F.lit("#top")).alias("href"))
    return R.toc_labels(_conv(spark, d), toc).select("book_id", "section_index", "chapter")


@_query("""with b as (select doc_id book_id, source creator, lang title, '2020-0' || (doc_id % 9 + 1) pub_date, 'id-' || doc_id identifier from documents)
select book_id, '@book{' || regexp_replace(lower(creator), '[^\\p{L}\\p{N}]', '', 'g') || '2020' || title || e',\\n  title     = {' || title || e'},\\n  author    = {' || creator || e'},\\n  publisher = {Self-Published},\\n  year      = {2020},\\n  language  = {'
|| title || e'},\\n  isbn      = {' || identifier || e'}\\n}' bibtex, creator || '. *' || title || '*. N.p.: n.p., 2020.' chicago from b""")
def bibtex_chicago(spark, d):  # noqa: ANN001, ANN201
    none = F.lit(None).cast("string")
    return R.more_citations(_table(spark, d, "documents").select(F.col("doc_id").alias("book_id"), F.col("lang").alias("title"), F.col("source").alias("creator"), none.alias("publisher"), F.concat(F.lit("2020-0"), (F.col("doc_id") % 9 + 1).cast("string")).alias("pub_date"), F.col("lang").alias("language"), F.concat(F.lit("id-"), F.col("doc_id").cast("string")).alias("identifier")))


@_query(f"""with s as (select book_id, case when si % 3 = 0 then '' else href end href, case when si % 4 = 1 then '' else t end t from {_C}),
f as (select book_id, unnest([case when trim(href) = '' then 'Error' end, case when trim(t) = '' then 'Warning' end]) severity from s)
select book_id, count(*) filter (severity = 'Error') errors, count(*) filter (severity = 'Warning') warnings, 0::bigint infos, count(*) filter (severity = 'Error') = 0 is_valid from f group by 1""")
def validation_counts(spark, d):  # noqa: ANN001, ANN201
    i = F.col("section_index")
    sections = _conv(spark, d).withColumn("href", F.when(i % 3 == 0, "").otherwise(F.col("href"))).withColumn("plain_text", F.when(i % 4 == 1, "").otherwise(F.col("plain_text")))
    return R.fault_counts(sections.select("book_id").distinct(), R.section_faults(sections))


@_query("""select 'f-' || doc_id || '.json' path, 'urn:' || doc_id id, lang title, [source] authors, 'b-' || doc_id || '.epub' href from documents""")
def opds_entries(spark, d):  # noqa: ANN001, ANN201
    pub = F.struct(F.struct(F.concat(F.lit("urn:"), F.col("doc_id").cast("string")).alias("identifier"), F.col("lang").alias("title"), F.struct(F.col("source").alias("name")).alias("author")).alias("metadata"), F.array(F.struct(F.lit("cover.png").alias("href"), F.lit("image/png").alias("type"), F.lit("cover").alias("rel")), F.struct(F.concat(F.lit("b-"), F.col("doc_id").cast("string"), F.lit(".epub")).alias("href"), F.lit("application/epub+zip").alias("type"), F.lit(None).cast("string").alias("rel"))).alias("links"))
    feeds = _table(spark, d, "documents").select(F.concat(F.lit("f-"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"), F.to_json(F.struct(F.array(pub).alias("publications"))).alias("text"))
    return side.catalogues(feeds).select("path", "id", "title", "authors", R.download_link(F.col("links"))["href"].alias("href"))


@_query("""select conv_id book_id, turn::bigint section_index, 'audio/' || conv_id || '.mp3' audio_path, turn * 2.5::double clip_begin, (turn + 1) * 2.5::double clip_end, 'p' || turn element_id from conversations""")
def smil_overlays(spark, d):  # noqa: ANN001, ANN201
    i, book = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    par = F.concat(F.lit("<smil><body><seq id='s'><par id='x"), i, F.lit("'><text src='../text/c.xhtml#p"), i, F.lit("'/><audio src='../audio/"), book, F.lit(".mp3' clipBegin='0:00:"), (F.col("turn") * 2.5).cast("string"), F.lit("' clipEnd='"), ((F.col("turn") + 1) * 2.5).cast("string"), F.lit("s'/></par></seq></body></smil>"))
    files = _table(spark, d, "conversations").select(F.concat(F.lit("smil/"), book, F.lit("/"), i).alias("path"), par.alias("text"))
    rows = side.overlays(files.withColumn("path", F.concat(F.lit("smil/"), F.translate("path", "/", "-"))))
    name = F.split(F.substring_index("path", "/", -1), "-")
    return rows.select(F.element_at(name, -2).cast("long").alias("book_id"), F.element_at(name, -1).cast("long").alias("section_index"), "audio_path", "clip_begin", "clip_end", "element_id")


@_query("select conv_id book_id, 'a.mp3' audio, turn * 10.0::double + 4 as seconds, '#p' || turn text_src from conversations")
def text_at_time(spark, d):  # noqa: ANN001, ANN201
    t, seconds = _table(spark, d, "conversations"), (F.col("turn") * 10).cast("double")
    overlays = t.select(F.col("conv_id").alias("book_id"), F.lit(0).alias("seq"), F.col("turn").alias("ord"), F.concat(F.lit("#p"), F.col("turn").cast("string")).alias("text_src"), F.lit("c").alias("text_path"), F.lit("e").alias("element_id"), F.lit("x/a.mp3").alias("audio_src"), F.lit("x/a.mp3").alias("audio_path"), seconds.alias("clip_begin"), (seconds + 9).alias("clip_end"))
    return R.text_at_time(overlays, t.select(F.col("conv_id").alias("book_id"), F.lit("a.mp3").alias("audio"), (seconds + 4).alias("seconds"))).select("book_id", "audio", "seconds", "text_src")


@_query("select event_id, floor((event_id % 90000) / 3600) * 3600 + floor((event_id % 3600) / 60) * 60 + event_id % 60 + 0.5::double as seconds from events")
def smil_clock(spark, d):  # noqa: ANN001, ANN201
    e = F.col("event_id")
    text = F.format_string("%d:%02d:%02d.5", F.floor((e % 90000) / 3600), F.floor((e % 3600) / 60), e % 60)
    return _table(spark, d, "events").select("event_id", T.clock_seconds(text).alias("seconds"))


@_query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') < '1996-06-01' expired from orders")
def lcp_expiry(spark, d):  # noqa: ANN001, ANN201
    licence = F.to_json(F.struct(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("end")).alias("rights")))
    return _table(spark, d, "orders").select("o_orderkey", R.expired(R.licences(licence)["rights"]["end"], F.lit("1996-06-01T00:00:00Z")).alias("expired"))


@_query("select doc_id, 'OEBPS/img/p ' || doc_id || '+.png' path, 'image/png' mime from documents")
def resolve_path(spark, d):  # noqa: ANN001, ANN201
    path = T.resolve_path(F.lit("OEBPS/text"), F.concat(F.lit("../img/./p%20"), F.col("doc_id").cast("string"), F.lit("+.png?v=2#x")))
    return _table(spark, d, "documents").select("doc_id", path.alias("path"), T.mime_type(path).alias("mime"))


@_query("select doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '&#38;&amp;&amp;x' repaired from documents where not regexp_matches(text, '&[a-z#]')")
def xml_repair(spark, d):  # noqa: ANN001, ANN201
    text = F.replace(F.replace(F.col("text"), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return _table(spark, d, "documents").where(~F.col("text").rlike("&[a-z#]")).select("doc_id", T.repair_xml(F.concat(text, F.lit("&#38;&amp;&x"))).alias("repaired"))


@_query("select page_id, (page_id % 900 + 100)::double width, 800.0::double height from pages")
def viewport_meta(spark, d):  # noqa: ANN001, ANN201
    html = F.concat(F.lit('<meta name="viewport" content="width='), (F.col("page_id") % 900 + 100).cast("string"), F.lit(', height=800">'), "html")
    width, height = T.viewport(html)
    return _table(spark, d, "pages").select("page_id", width.alias("width"), height.alias("height"))


@_query("select conv_id book_id, turn::bigint section_index, unnest(['n' || turn, 'aside' || turn]) note_id, unnest(['note ' || turn, 'alone']) note_text from conversations")
def footnotes(spark, d):  # noqa: ANN001, ANN201
    i = F.col("turn").cast("string")
    html = F.concat(F.lit('<p>x<a epub:type="noteref" href="#n'), i, F.lit('">1</a></p><aside id="n'), i, F.lit('"><p>note '), i, F.lit('</p></aside><aside id="aside'), i, F.lit('">alone</aside>'))
    return B.footnotes(_table(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").cast("long").alias("section_index"), html.alias("raw_html")))


@_query("select conv_id book_id, turn::bigint section_index, 0::bigint block_index, 'python' as language, unnest(['comment', 'function_definition']) kind, unnest([0, 6])::integer start_byte, unnest([5, 15])::integer end_byte, unnest([0, 1])::integer as row from conversations")
def code_blocks(spark, d):  # noqa: ANN001, ANN201
    html = F.lit('<pre><code class="language-python"># one\n def f():\n  x</code></pre>')
    blocks = B.code_blocks(_table(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").cast("long").alias("section_index"), html.alias("raw_html")))
    return R.code_lines(blocks)


@_query(f"""with f as (select book_id, count(*) total_sections, sum(length(t))::bigint c from {_C} group by 1),
b as (select *, coalesce(lag(c) over w / c::double, 0) < (0.85 - 0.6) / 0.4 br from f where c > 0 window w as (partition by total_sections order by c, book_id)),
r as (select *, sum(br::int) over (partition by total_sections order by c, book_id) run from b)
select book_id, leader from (select book_id, min(book_id) over (partition by total_sections, run) leader, count(*) over (partition by total_sections, run) k from r) where k > 1""")
def dup_metadata(spark, d):  # noqa: ANN001, ANN201
    same = B.metadata_hash(F.lit(" Title"), F.lit("x"), F.lit(None).cast("string"))
    return R.metadata_duplicates(B.fingerprints(_conv(spark, d)).withColumn("metadata_hash", same))


@_query("select 'a' || doc_id id, '{\"@context\":\"http://www.w3.org/ns/anno.jsonld\",\"id\":\"urn:annotation:a' || doc_id || '\",\"type\":\"Annotation\",\"motivation\":\"' || case when doc_id % 2 = 0 then 'highlighting' else 'commenting' end || '\",\"target\":{\"selector\":{\"type\":\"FragmentSelector\",\"conformsTo\":\"http://www.idpf.org/epub/linking/cfi/epub-cfi.html\",\"value\":\"epubcfi(/6/2)\"}},\"body\":{\"type\":\"TextualBody\",\"value\":\"' || lang || '\",\"format\":\"text/plain\"},\"created\":\"' || doc_id || '\"}' json from documents")
def w3c_annotations(spark, d):  # noqa: ANN001, ANN201
    own = F.col("doc_id").cast("string")
    return R.w3c_annotations(_table(spark, d, "documents").select(F.concat(F.lit("a"), own).alias("id"), F.when(F.col("doc_id") % 2 == 0, "highlight").otherwise("note").alias("type"), F.lit("epubcfi(/6/2)").alias("cfi_range"), F.col("lang").alias("note"), own.alias("created_at")))


@_query("""with s as (select conv_id, string_agg('{"href":"t' || turn || '","type":"application/xhtml+xml","title":"Section ' || (turn + 1) || '"}', ',' order by turn) o, string_agg('{"href":"t' || turn || '","type":"application/xhtml+xml","title":"' || role || '"}', ',' order by turn) t from conversations group by 1)
select conv_id book_id, '{"@context":"https://readium.org/webpub-manifest/context.jsonld","metadata":{"@type":"http://schema.org/Book","title":"Conv","author":["a"],"language":["en"],"readingProgression":"ltr"},"links":[{"href":"manifest.json","type":"application/webpub+json","rel":"self"}],"readingOrder":[' || o || '],"toc":[' || t || ']}' json from s""")
def webpub_manifest(spark, d):  # noqa: ANN001, ANN201
    t = _table(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("i"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("href"), F.col("role").alias("label"))
    books = t.select("book_id").distinct().select("book_id", F.lit("Conv").alias("title"), F.array(F.lit("a")).alias("creators"), F.lit(None).cast("string").alias("publisher"), F.array(F.lit("en")).alias("languages"), F.lit("default").alias("direction"))
    toc = t.select("book_id", F.col("i").alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.col("i").alias("ord"), F.lit(0).alias("depth"), "label", "href")
    return R.webpub_manifest(books, t.select("book_id", F.col("i").alias("spine_index"), "href", F.lit("").alias("media_type")), toc)


@_query("select page_id, html sanitized from (select page_id, regexp_replace(html, '(?s)<script[^>]*>.*?</script>', '', 'g') html from pages)")
def sanitize(spark, d):  # noqa: ANN001, ANN201
    return _table(spark, d, "pages").select("page_id", M.sanitized(F.concat(F.col("html"), F.lit("<iframe src=x>"))).alias("sanitized"))


@_query("select page_id, case when page_id % 2 = 0 then replace(html, '<html', '<html dir=\"rtl\"') else html end html from pages")
def right_to_left(spark, d):  # noqa: ANN001, ANN201
    return _table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, M.right_to_left(F.col("html"))).otherwise(F.col("html")).alias("html"))


@_query("""with s as (select conv_id book_id, turn::bigint i, turn // 2 p, text from conversations)
select book_id, max(case when i % 2 = 0 then i end) left_index, max(case when i % 2 = 1 then i end) right_index, max(case when i % 2 = 0 then text end) left_html, max(case when i % 2 = 1 then text end) right_html from s group by book_id, p""")
def spreads(spark, d):  # noqa: ANN001, ANN201
    none = F.lit(None).cast("double")
    sections = _conv(spark, d).withColumn("raw_html", F.col("plain_text")).withColumn("viewport_width", none).withColumn("viewport_height", none)
    return R.spreads(sections).select("book_id", "left_index", "right_index", "left_html", "right_html")
