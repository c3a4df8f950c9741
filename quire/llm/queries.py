"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, cap_dedup, html_extract, line_dedup, ngram_join, packing, quality, surrogates, toxicity, url_filter

#: (verdict, host, path) of the contract.
RULES = [url_filter.Rule("block", "net"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]
VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(_table(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_odds", "words")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_dedup.link_vectors(_table(spark, sf_dir, "embeddings"), 0.98)


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (~toxicity.learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(_table(spark, sf_dir, "documents"), 4, 0.85)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_embedding_dedup, op3_surrogates, op4_quality, op5_toxicity, op6_line_dedup, op7_packing, op8_html_extract, op9_bpe, op10_ngram_join, pipeline)}


_REACH = "reach as (select id, id root from nodes union select r.id, e.b from reach r join links e on e.a = r.root)"
#: All pairs, for tables of some thousand rows.
_VECTORS = f"""with recursive nodes as (select vec_id id, embedding::double[] e, label from embeddings where vec_id is not null and label is not null and len(embedding) > 0
  and list_bool_and([coalesce(isfinite(x), false) for x in embedding]) and list_bool_or([x <> 0 for x in embedding])),
links as (select x.id a, y.id b from nodes x join nodes y on x.label = y.label and x.id <> y.id and len(x.e) = len(y.e) and list_cosine_similarity(x.e, y.e) >= 0.98), {_REACH}
select vec_id, (select count(*) from links where a = vec_id) n_links, coalesce((select min(root) from reach where id = vec_id), vec_id) component_id,
  vec_id = coalesce((select min(root) from reach where id = vec_id), vec_id) kept from embeddings"""
_DOCUMENTS = f"""with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
sets as (select doc_id id, case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) end s from words),
nodes as (select id, len(s) n from sets), each as (select id, unnest(list_transform(s, lambda t: hash(t))) x from sets), shared as (select a.id a, b.id b, count(*) c from each a join each b on a.x = b.x and a.id <> b.id group by 1, 2),
links as (select s.a, s.b from shared s join nodes x on x.id = s.a join nodes y on y.id = s.b where 100 * c >= 85 * (x.n + y.n - c)), {_REACH}
select n.id doc_id, n.n::bigint n_shingles, min(r.root) component_id from nodes n join reach r on r.id = n.id group by 1, 2"""


def oracle_sql() -> dict[str, str]:
    """All-pairs SQL for the two joins. The other queries hold a model, a tokenizer, a parser or keyed draws; tests/llm has brute-force versions and properties."""
    return {"op2_embedding_dedup": _VECTORS, "op10_ngram_join": _DOCUMENTS}
