"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm import extraction, language, lm, media, mixing, packing, pii, quality, simhash, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_words(table(spark, sf_dir, "documents"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored_corpus(table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = language.identified(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat(x["lang"], F.lit(":"), x["words"])), " ")
    return made.withColumn("spans", spans)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.pseudonymised(table(spark, sf_dir, "documents"), pii.session_key(spark))
    kinds = F.array_join(F.transform("found", lambda x: F.concat(x["kind"], F.lit("@"), x["start"], F.lit("+"), x["length"])), " ")
    return made.select("doc_id", "text", "n_chars", "n_found", kinds.alias("found"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_packing, op2_extraction, op3_media, op4_mixing, op5_lm, op6_urls, op7_simhash, op8_quality, op9_language, op10_pii)
}

_WORD = r"[^\x20\x09-\x0D]+"
_MIX = rf"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
 w AS (SELECT *, 1 + (k - 1) % 3 AS weight FROM s),
 o AS (SELECT *, row_number() OVER (ORDER BY 3 * n / weight::DOUBLE, k) AS place FROM w),
 r AS (SELECT *, (SELECT sum(n) FROM w) - coalesce(sum(3 * n) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER (ORDER BY place DESC) AS open_weight FROM o),
 f AS (SELECT *, bool_and(3 * n * open_weight <= rest * weight) OVER (ORDER BY place) AS filled FROM r),
 t AS (SELECT f.source, f.n, CASE WHEN filled THEN (3 * n)::DOUBLE ELSE (l.rest * f.weight)::DOUBLE / l.open_weight::DOUBLE END AS target FROM f LEFT JOIN (SELECT rest, open_weight FROM f WHERE NOT filled ORDER BY place LIMIT 1) l ON true),
 c AS (SELECT *, CASE WHEN n > 0 THEN least(3, floor(target / n))::BIGINT ELSE 0 END AS copies FROM t),
 b AS (SELECT *, least(n, floor(target - copies * n + 0.5))::BIGINT AS budget FROM c),
 q AS (SELECT d.*, b.n, b.target, b.copies, b.budget, sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS tied FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
 SELECT doc_id, size, n AS source_size, target, CAST(copies * size + CASE WHEN size = 0 THEN 0 WHEN upto <= budget THEN size WHEN upto - tied < budget THEN size * (budget - (upto - tied)) // tied ELSE 0 END AS BIGINT) AS taken FROM q"""
_URLS = """WITH rules(verdict, rh, rp) AS (VALUES ('block','com','/en/'),('allow','example.com','/en/7'),('allow','net','/de/'),('block','example.net','/de/8'),('block','org','/es/')),
 u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
 p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
 m AS (SELECT p.*, verdict, rh || rp AS rule, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k FROM (SELECT DISTINCT * FROM p) p LEFT JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp))
 SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p JOIN m ON p.page_id IS NOT DISTINCT FROM m.page_id AND p.host = m.host AND p.path = m.path AND m.k = 1"""
_RULES = rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
 w AS (SELECT row, doc_id, text, regexp_extract_all(text, '{_WORD}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
 i AS (SELECT row, len(words) AS n, words, unnest(range(1, len(words) - 3)) AS k FROM w WHERE len(words) >= 5),
 g AS (SELECT row, k, count(*) OVER (PARTITION BY row, words[k:k+4]) AS many FROM i),
 c AS (SELECT row, count(DISTINCT k + j) AS repeated FROM g, (VALUES (0),(1),(2),(3),(4)) o(j) WHERE many > 1 GROUP BY row),
 b AS (SELECT w.row, doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(repeated, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
  len(list_filter(words, lambda x: (length(x) > 1 AND upper(x) = x AND lower(x) <> x) OR suffix(x, '!!'))) AS loud, len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS lettered,
  len(list_filter(range(2, len(words) + 1), lambda x: words[x] = words[x - 1])) AS stutters FROM w LEFT JOIN c ON c.row = w.row)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > n_words OR 10 * stutters > 3 * n_words OR 10 * n_dup_lines > 5 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * loud > 3 * n_words OR 10 * lettered < 3 * n_words) AS kept FROM b"""
#: The other operators have no SQL (a tokenizer, XXH64, trained models, parsers, keyed permutations): tests hold them against brute force.
ORACLES: dict[str, str] = {"op4_mixing": _MIX, "op6_urls": _URLS, "op8_quality": _RULES}
