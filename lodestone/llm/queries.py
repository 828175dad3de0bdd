"""The queries of the ten operators over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(_read(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(_read(spark, sf_dir, "pages"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import train_and_score

    return train_and_score(_read(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(_read(spark, sf_dir, "documents"))


def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .edit_counts import edited_counts

    return edited_counts(_read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(_read(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import encode

    return encode(_read(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), digest=True)


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2_license_scan tells by fixed phrases alone, with -1 for no place; SQL can say that."""
    from pyspark.sql import functions as F

    return op2_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", F.coalesce("first_word", F.lit(-1)).alias("first_word"), F.coalesce("last_word", F.lit(-1)).alias("last_word"), "base_labels")


def urls_ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3_url_filter tells by rules alone; SQL can say that."""
    from pyspark.sql import functions as F

    return op3_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_pack": op1_pack, "op2_license_scan": op2_license_scan, "op3_url_filter": op3_url_filter, "op4_lm_score": op4_lm_score, "op5_exact_dedup": op5_exact_dedup, "op6_edit_counts": op6_edit_counts, "op7_language_id": op7_language_id, "op8_byte_bpe": op8_byte_bpe, "op9_ngram_join": op9_ngram_join, "op10_embedding_dedup": op10_embedding_dedup, "licenses_base": licenses_base, "urls_ruled": urls_ruled}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL: dict[str, str] = {
    "licenses_base": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, list_filter(range(0, len(w)), lambda i: w[i + 1] = 'mit' AND w[i + 2] = 'license') AS m,
  list_filter(range(0, len(w)), lambda i: w[i + 1] = 'apache' AND w[i + 2] = 'license') AS a,
  list_filter(range(0, len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS g FROM w)
SELECT doc_id, n AS n_words, len(m) + len(a) + len(g) AS n_base, coalesce(list_min(m || a || g), -1) AS first_word, coalesce(list_max(m || a || g), -1) AS last_word,
  concat_ws(',', CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(m) > 0 THEN 'mit' END) AS base_labels FROM p""",
    "urls_ruled": rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
v AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER}), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT *, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM v)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM r""",
    "op5_exact_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)""",
    "op9_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT t, min(doc_id) AS class_id, count(*) AS n_copies FROM d GROUP BY t),
w AS (SELECT class_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM c),
g AS (SELECT DISTINCT class_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT class_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS k FROM g a JOIN g b USING (g) WHERE a.class_id <> b.class_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.class_id = a JOIN n y ON y.class_id = b WHERE k >= 0.5 * (x.n + y.n - k)),
r AS (SELECT class_id, class_id AS reach FROM c UNION SELECT r.class_id, l.b FROM r JOIN l ON l.a = r.reach),
m AS (SELECT class_id, min(reach) AS group_id FROM r GROUP BY 1),
f AS (SELECT a AS class_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT doc_id, class_id, n_copies, coalesce(n_links, 0) AS n_links, group_id, doc_id = group_id AS kept
FROM d JOIN c USING (t) JOIN m USING (class_id) LEFT JOIN f USING (class_id)""",
    "op10_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.norm > 0 AND b.norm > 0 AND isfinite(a.norm) AND isfinite(b.norm) AND list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.norm * b.norm) >= 0.93),
r AS (SELECT vec_id, vec_id AS reach FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reach),
m AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY 1),
f AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN f USING (vec_id)""",
}
