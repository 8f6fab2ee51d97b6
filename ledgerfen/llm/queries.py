"""Queries p5 to p8 over the test tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encode, language, leaks, seen_keys


def _load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen_keys.seen_before(_load(spark, sf_dir, "wal"))


def p5_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, answers "seen" and wrong answers of each database."""
    wal = _load(spark, sf_dir, "wal")
    return seen_keys.error_rate(wal, seen_keys.seen_before(wal))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(_load(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again, from their ids."""
    return encode.decode(p6_ids(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find_leaks(_load(spark, sf_dir, "documents"), _load(spark, sf_dir, "eval_items"), min_match=15, min_longest=15)
    return found.select("doc_id", "item_id")


def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with four fifths of the item in tiles of five words and more, in any order."""
    found = leaks.find_leaks(_load(spark, sf_dir, "documents"), _load(spark, sf_dir, "eval_items"), min_match=5, min_coverage=0.8)
    return found.select("doc_id", "item_id", "tiles", "longest", "covered", "item_words")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.wrong_labels(language.languages(_load(spark, sf_dir, "documents"))).select("doc_id", "seg_no", "seg_lang")


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document and of each line of eight words, with its confidence."""
    return language.languages(_load(spark, sf_dir, "documents")).select("doc_id", "seg_no", "words", "seg_lang", F.round("confidence", 6).alias("confidence"))


QUERIES = {f.__name__: f for f in (p5_found, p5_error, p6_ids, p6_decoded, p7_found, p7_coverage, p8_found, p8_languages)}

_PLAIN = """regexp_replace(replace(strip_accents(lower(nfc_normalize(replace(regexp_replace(regexp_replace(
    text, '[\\x{200b}\\x{200c}\\x{200d}\\x{2060}\\x{feff}]+', '', 'g'), '[-\\x{ad}\\x{2010}\\x{2011}]\\s*\\n\\s*', '', 'g'), chr(173), '')))), 'ß', 'ss'),
    '\\([^()]*\\)|\\[[^\\[\\]]*\\]', ' ', 'g')"""


def _grams(table: str, key: str) -> str:
    return f"""(SELECT DISTINCT {key}, array_to_string(w[i : i + 14], ' ') AS gram
        FROM (SELECT {key}, w, unnest(range(1, len(w) - 13)) AS i FROM (SELECT {key}, regexp_extract_all({_PLAIN}, '[\\p{{L}}\\p{{N}}]+') AS w FROM {table})))"""


_SEEN = """log AS (SELECT DISTINCT db_id, wal_id, rec_no, key FROM wal
    WHERE key IS NOT NULL AND seq IS NOT NULL AND len = octet_length(encode(key)) + CASE vtype WHEN 1 THEN 29 WHEN 2 THEN 13 END),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY db_id, key ORDER BY wal_id, rec_no) AS n FROM log)"""

ORACLE = {
    "p5_found": f"WITH {_SEEN} SELECT db_id, wal_id, rec_no FROM ranked WHERE n > 1",
    "p5_error": f"""WITH {_SEEN} SELECT db_id, count(*) AS records, count(*) FILTER (WHERE n > 1) AS seen, CAST(0 AS BIGINT) AS wrong, CAST(0 AS DOUBLE) AS rate
        FROM ranked GROUP BY db_id""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_found": f"SELECT DISTINCT d.doc_id, i.item_id FROM {_grams('documents', 'doc_id')} d JOIN {_grams('eval_items', 'item_id')} i ON d.gram = i.gram",
}
