"""Queries for the book operators over the driver's tables, each with DuckDB SQL for the same rows.

documents are books of one section; conversations books whose turns are sections; pages are sections of HTML.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import books as B
from quire.plans import lookups, parts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("book_id"), F.lit(0).alias("section_index"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("href"), F.coalesce("text", F.lit("")).alias("plain_text"))


def _conv(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("section_index"), F.concat(F.lit("turn-"), F.col("turn").cast("string")).alias("href"), F.coalesce("text", F.lit("")).alias("plain_text"))


_D = "(select doc_id book_id, 0::bigint si, 'doc-' || doc_id href, coalesce(text, '') t from documents)"
_C = "(select conv_id book_id, turn::bigint si, 'turn-' || turn href, coalesce(text, '') t from conversations)"
_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


def _search_sql(source: str, q: str, hit: str = "") -> str:
    n = len(q)
    return f"""
with p as (select book_id, si, href, t, string_split(lower(t), '{q}') parts from {source}),
e as (select book_id, si, href, t, generate_subscripts(parts, 1) k, unnest(parts) g, len(parts) m from p),
h as (select *, (sum(length(g)) over (partition by book_id, si order by k) + (k - 1) * {n})::bigint a from e qualify k < m)
select book_id, si spine_index, a char_offset, 'epubcfi(/6/' || (2 * (si + 1)) || '[' || href || ']!/4/2/1:' || a || ')' cfi,
  case when a > 40 then '...' else '' end || {_ESC.format("substr(t, greatest(a - 40, 0) + 1, least(a, 40))")} || '<mark>' || {_ESC.format(f"substr(t, a + 1, {n})")}
  || '</mark>' || {_ESC.format(f"substr(t, a + {n} + 1, 40)")} || case when a + {n} + 40 < length(t) then '...' else '' end snippet from h {hit}"""


@_query(_search_sql(_D, "the"))
def search_literal(spark, d):  # noqa: ANN001, ANN201
    return B.search(_docs(spark, d), "the")


@_query(_search_sql(_C, "and"))
def search_literal_conv(spark, d):  # noqa: ANN001, ANN201
    return B.search(_conv(spark, d), "AND")


@_query(_search_sql(_D, "the") + " order by 1, 2, 3 limit 500")
def search_top500(spark, d):  # noqa: ANN001, ANN201
    return B.top_hits(B.search(_docs(spark, d), "the"))


@_query("select doc_id book_id, ((length(text) - length(replace(lower(text), 'the', ''))) / 3)::bigint n_hits from documents where contains(lower(text), 'the')")
def search_counts(spark, d):  # noqa: ANN001, ANN201
    return B.search(_docs(spark, d), "the").groupBy("book_id").agg(F.count("*").alias("n_hits"))


@_query("select doc_id book_id, len(regexp_extract_all(text, '[0-9]+'))::bigint n_hits from documents where regexp_matches(text, '[0-9]')")
def search_regex_count(spark, d):  # noqa: ANN001, ANN201
    return B.search_regex(_docs(spark, d), "[0-9]+").groupBy("book_id").agg(F.count("*").alias("n_hits"))


@_query(f"select book_id, si spine_index, a char_offset, (a // 1000 + 1)::bigint position from (select book_id, spine_index si, char_offset a from ({_search_sql(_D, 'the')}))")
def readium_search(spark, d):  # noqa: ANN001, ANN201
    return B.search(_docs(spark, d), "the").select("book_id", "spine_index", "char_offset", (F.floor(F.col("char_offset") / 1000) + 1).cast("long").alias("position"))


_WORDS = r"[v for v in [regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') for w in regexp_split_to_array(t, '\s+')] if v <> '']"


@_query(f"""with w as (select book_id, si, {_WORDS} w from {_D}), n as (select book_id, si section_index, len(w)::bigint word_count, list_sum([length(x) for x in w]) c from w)
select book_id, section_index::integer section_index, word_count, floor((word_count + 10) / 20) / 10 reading_time_minutes,
case when word_count = 0 then 0.0::double else round(least(((c::float / word_count::float)::float * 1.5::float)::double, 10.0::double), 1) end difficulty_score from n""")
def reading_analytics(spark, d):  # noqa: ANN001, ANN201
    return B.analytics(_docs(spark, d))


_STOP = ", ".join(f"'{w}'" for w in B.STOP_WORDS)
_COUNTS = f"select book_id, word, count(*) n from (select book_id, lower(unnest({_WORDS})) word from _SOURCE_) where strlen(word) >= 3 and word not in ({_STOP}) group by 1, 2"


@_query(_COUNTS.replace('_SOURCE_', _D))
def keyword_freq(spark, d):  # noqa: ANN001, ANN201
    return B.keyword_counts(_docs(spark, d), "book_id")


@_query(f"select * from (select *, row_number() over (partition by book_id order by n desc, word) rank from ({_COUNTS.replace("_SOURCE_", _D)})) where rank <= 10")
def top_keywords(spark, d):  # noqa: ANN001, ANN201
    return B.top_keywords(B.keyword_counts(_docs(spark, d), "book_id"), ["book_id"])


@_query(f"select book_id, sha256(string_agg(regexp_replace(t, '\\s', '', 'g'), '' order by si)) content_hash, count(*) total_sections, sum(length(t))::bigint total_characters from {_C} group by 1")
def fingerprint_conv(spark, d):  # noqa: ANN001, ANN201
    return B.fingerprints(_conv(spark, d))


@_query(f"with f as (select book_id, sha256(regexp_replace(t, '\\s', '', 'g')) h from {_D}) select book_id, leader from (select book_id, min(book_id) over (partition by h) leader, count(*) over (partition by h) c from f) where c > 1")
def dup_groups(spark, d):  # noqa: ANN001, ANN201
    return B.duplicate_groups(B.fingerprints(_docs(spark, d)))


@_query(f"""with n as (select book_id, si, length(t) n, greatest(ceil(length(t) / 256.0), 1)::bigint r from {_C}), b as (select *, (sum(r) over (partition by book_id order by si) - r)::bigint before from n)
select book_id, before + k + 1 as location, si spine_index, k * 256 char_start, least((k + 1) * 256, n)::bigint char_end from (select *, unnest(range(r)) k from b)""")
def locations(spark, d):  # noqa: ANN001, ANN201
    return B.locations(_conv(spark, d), 256)


@_query(f"select book_id, 0::integer section_index, k + 1 page_number, k * 1660 start_char, least((k + 1) * 1660, length(t))::bigint end_char from (select *, unnest(range(greatest(ceil(length(t) / 1660.0), 1)::bigint)) k from {_D})")
def paginate(spark, d):  # noqa: ANN001, ANN201
    return B.paginate(_docs(spark, d))


@_query()
def rag_chunks(spark, d):  # noqa: ANN001, ANN201
    return B.rag_chunks(_docs(spark, d))


@_query("""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'),
'(?s)<!--.*?-->', ' ', 'g'), '<([^<>"'']|"[^"]*"|''[^'']*'')*>', ' ', 'g'), '\\s+', ' ', 'g')) plain_text from pages""")
def plain_text(spark, d):  # noqa: ANN001, ANN201
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", T.plain_text(F.col("html")).alias("plain_text"))


@_query(f"select doc_id, {_ESC.format('text')} escaped from documents")
def html_escape(spark, d):  # noqa: ANN001, ANN201
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.html_escape(F.col("text")).alias("escaped"))


@_query(f"select book_id, si, 'epubcfi(/6/' || (2 * (si + 1)) || '[' || href || ']!/4/2/1:' || (length(t) // 2) || ')' cfi, si spine_index, (length(t) // 2)::bigint char_offset from {_C}")
def cfi_round_trip(spark, d):  # noqa: ANN001, ANN201
    made = _conv(spark, d).select("book_id", F.col("section_index").cast("long").alias("si"), T.cfi(F.col("section_index").cast("long"), F.col("href"), F.floor(F.length("plain_text") / 2)).alias("cfi"))
    return made.select("*", T.cfi_spine_index(F.col("cfi")).alias("spine_index"), T.cfi_char_offset(F.col("cfi")).alias("char_offset"))


@_query(f"""with w as (select book_id, si, regexp_split_to_array(trim(regexp_replace(t, '\\s+', ' ', 'g')), ' ') w from {_C}),
e as (select book_id, si, generate_subscripts(w, 1) - 1 k, unnest(w) word from w), a as (select *, (sum(length(word) + 1) over (partition by book_id, si order by k) - length(word) - 1)::bigint s from e)
select book_id, si section_index, k::bigint token_index, word, s start_char, (s + length(word))::bigint end_char from a where word <> ''""")
def tts_tokens(spark, d):  # noqa: ANN001, ANN201
    return B.tts_tokens(_conv(spark, d).withColumn("section_index", F.col("section_index").cast("long")))


# the name that the query over every turn had while tts_tokens had first turns only
_QUERIES["tts_tokens_all"], _SQL["tts_tokens_all"] = tts_tokens, _SQL["tts_tokens"]


@_query("""with b as (select conv_id book_id, min(case when turn = 0 then role end) title, count(*) n from conversations group by 1)
select book_id, unnest(['PKG-002', 'PKG-003', 'PKG-004', 'NAV-001', 'A11Y-001']) code, unnest(['Warning', 'Warning', 'Info', 'Warning', 'Info']) severity from b""")
def validation_report(spark, d):  # noqa: ANN001, ANN201
    books = spark.read.parquet(f"{d}/conversations.parquet").groupBy(F.col("conv_id").alias("book_id")).agg(F.min(F.when(F.col("turn") == 0, F.col("role"))).alias("title"), F.count("*").alias("n_spine"))
    none = F.lit(None).cast("string")
    return B.validation(books.select("book_id", "title", none.alias("identifier"), none.alias("language"), none.alias("creator"), "n_spine", F.col("n_spine").alias("n_sections"), F.lit(0).alias("n_toc"), F.array().cast("array<string>").alias("access_modes")))


@_query("""select doc_id book_id, regexp_replace(lower(source), '[^\\p{L}\\p{N}]', '', 'g') || '2026' || lang cite_key, source || ' (n.d.). *' || lang || '*.' apa, source || '. *' || lang || '*.' mla from documents""")
def citations(spark, d):  # noqa: ANN001, ANN201
    none = F.lit(None).cast("string")
    return B.citations(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("book_id"), F.col("lang").alias("title"), F.col("source").alias("creator"), none.alias("publisher"), none.alias("pub_date")))


@_query("""with t as (select conv_id book_id, turn::bigint node_id, case when turn > 0 then turn - 1 end parent_id, role label from conversations)
select book_id, node_id, label, node_id depth, string_agg(label, ' > ') over (partition by book_id order by node_id) breadcrumb from t""")
def toc_flatten(spark, d):  # noqa: ANN001, ANN201
    toc = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("book_id"), F.col("turn").cast("long").alias("node_id"), F.when(F.col("turn") > 0, F.col("turn") - 1).cast("long").alias("parent_id"), F.lit(0).alias("ord"), F.col("role").alias("label"))
    return B.toc_flatten(toc)


@_query("select quality, toxic, count(*) n_docs, sum(length(text))::bigint n_characters from documents join labels using (doc_id) group by 1, 2")
def labelled_stats(spark, d):  # noqa: ANN001, ANN201
    return spark.read.parquet(f"{d}/documents.parquet").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).cast("long").alias("n_characters"))


def queries() -> dict[str, Query]:
    return {**_QUERIES, **lookups.QUERIES, **parts.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**_SQL, **lookups.SQL, **parts.SQL}
