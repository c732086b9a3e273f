"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import best_fit_packing, exact_dedup, media_sniff, ngram_join, secret_links, sharding, source_mixing, substring_dedup, toxicity_chain, wavelet_shards
from lamella.llm.common import documents
from lamella.llm.tokenise import vocabulary

SHARDS = 40


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards(documents(spark, sf_dir), [1.0] * SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.packed(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op6_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_sniff.features(media_sniff.store(documents(spark, sf_dir)))


def op9_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet_shards.stored(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op2_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_links.scan(documents(spark, sf_dir))
    spans = F.col("spans")
    return found.select("doc_id", *(secret_links.count_of(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(secret_links.listed(secret_links.base_of(spans)), 256).alias("base_sha256"), secret_links.listed(spans).alias("spans"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mixture(documents(spark, sf_dir))


def _divided(level: str, parent: str, previous: str, weight: str) -> str:
    """SQL for one level of the water filling: ``previous`` has a row per leaf with its amount."""
    path = f"{parent}, {level}" if parent else level
    of = f"PARTITION BY {parent}" if parent else ""
    return f"""
{level}_w AS (SELECT {path}, any_value(amount) AS amount, sum(capacity)::HUGEINT AS cap, ({weight})::HUGEINT AS w FROM {previous} GROUP BY {path}),
{level}_r AS (SELECT *, cap::DOUBLE / w::DOUBLE AS ratio FROM {level}_w),
{level}_l AS (SELECT *, amount - coalesce(sum(cap) OVER ({of} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem,
  sum(w) OVER ({of}) - coalesce(sum(w) OVER ({of} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS others FROM {level}_r),
{level}_f AS (SELECT *, bool_and(cap * others <= rem * w) OVER ({of} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM {level}_l),
{level}_m AS (SELECT *, min(CASE WHEN NOT filled THEN row(ratio, {level}, rem, others) END) OVER ({of}) AS rest FROM {level}_f),
{level}_s AS (SELECT {path}, (CASE WHEN filled THEN cap ELSE (rest[3] * w)::HUGEINT // rest[4]::HUGEINT END)::HUGEINT AS share FROM {level}_m),
{level}_n AS (SELECT p.* EXCLUDE (amount), s.share AS amount FROM {previous} p JOIN {level}_s s USING ({path})),"""


_AIM = source_mixing.Mixture()
OP3_SQL = f"""
WITH d AS (SELECT doc_id, 'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT), 0) % 3) AS domain, coalesce(lang, '') AS language,
  coalesce(source, '') AS origin, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, language, origin, sum(n_tokens)::HUGEINT AS tokens FROM d GROUP BY ALL),
top AS (SELECT *, tokens * {_AIM.max_epochs} AS capacity, least((sum(tokens) OVER ())::HUGEINT * {_AIM.budget[0]} // {_AIM.budget[1]}, (sum(tokens) OVER ())::HUGEINT * {_AIM.max_epochs}) AS amount FROM leaf),
{_divided("domain", "", "top", _AIM.weights["domain"])}{_divided("language", "domain", "domain_n", _AIM.weights["language"])}{_divided("origin", "domain, language", "language_n", _AIM.weights["origin"])}
plan AS (SELECT domain, language, origin, CASE WHEN tokens > 0 THEN amount // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN amount % tokens ELSE amount END AS rest FROM origin_n),
placed AS (SELECT d.*, epochs, rest, ('0x' || substr(md5('{_AIM.seed}:' || (epochs + 1) || ':' || doc_id), 1, 15))::BIGINT AS h FROM d JOIN plan USING (domain, language, origin)),
prefix AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < rest AS more FROM placed),
taken AS (SELECT *, unnest(generate_series(1, (epochs + more::INT)::BIGINT)) AS epoch FROM prefix)
SELECT doc_id, domain, language, origin, n_tokens, epoch::INT AS epoch, ('0x' || substr(md5('{_AIM.seed}:' || epoch || ':' || doc_id), 1, 15))::BIGINT AS order_hash FROM taken
"""

def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_chain.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(documents(spark, sf_dir), texts=False)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity_chain, op2_secret_links, op3_source_mixing, op4_exact_dedup, op5_sharding, op6_media_sniff, op7_best_fit_packing, op8_substring_dedup, op9_wavelet_shards, op10_ngram_join)
}
ORACLES = {"op3_source_mixing": OP3_SQL, "op4_exact_dedup": OP4_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
