"""The dealt operators as registered queries over whole tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefork.llm import licenses, quality
from tracefork.llm.decontamination import leak_digest, mark_leaks
from tracefork.llm.fill_in_middle import FIM_SQL, fim_digest
from tracefork.llm.html_extraction import extract_text
from tracefork.llm.minhash import near_duplicates
from tracefork.llm.ngram_join import similar_documents
from tracefork.llm.packing import pack
from tracefork.llm.sharding import shard
from tracefork.llm.suffix_dedup import remove_repeats
from tracefork.llm.tables import table
from tracefork.llm.toxicity import grade_toxicity, train
from tracefork.llm.url_filter import judge_urls
from tracefork.llm.whitening import whiten

#: The rules of the url query: (verdict, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select(
        "doc_id",
        F.size("license_scan.sentences").cast("bigint").alias("n_sentences"),
        F.array_join("license_scan.licenses", ",").alias("licenses"),
        F.col("license_scan.license").alias("license"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grade_toxicity(docs, train(docs, table(spark, sf_dir, "labels")), keep_text=False)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *(F.col(f"quality.{c}") for c in QUALITY_COLUMNS))


QUALITY_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leak_digest(mark_leaks(docs, table(spark, sf_dir, "benchmark"), keep_text=False))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), added=True)


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digest(table(spark, sf_dir, "documents"))


URL_SQL = """
WITH rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
),
rest AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN regexp_replace(substr(url, strpos(url, '://') + 3), '[?#](.|\\n)*$', '') ELSE '' END AS r
  FROM pages
),
parts AS (
  SELECT page_id,
         translate(split_part(r, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(r, length(split_part(r, '/', 1)) + 1) AS path
  FROM rest
),
fits AS (
  SELECT p.page_id, arg_max(u.host || u.path, length(u.host) * 1000 + length(u.path)) AS rule,
         arg_max(u.verdict, length(u.host) * 1000 + length(u.path)) AS verdict
  FROM parts p JOIN rules u ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path)
  GROUP BY p.page_id
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f USING (page_id)
"""


def quality_sql() -> str:
    """The rules in SQL over the same threshold tables."""
    stop = ", ".join("'" + w + "'" for w in sorted(set(quality.STOP_WORDS)))

    def holds(rules: tuple[quality.Rule, ...]) -> str:
        tests = []
        for r in rules:
            unseen = f" OR {r.seen} = 0" if r.seen else ""
            if r.low is not None:
                tests.append(f"({r.scale} * {r.value} >= {r.low} * {r.base}{unseen})")
            if r.high is not None:
                tests.append(f"({r.scale} * {r.value} <= {r.high} * {r.base}{unseen})")
        return " AND ".join(tests)

    return f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents
),
placed AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM cut WHERE len(w) > 2),
windows AS (SELECT doc_id, p, w[p] || chr(1) || w[p + 1] || chr(1) || w[p + 2] AS g FROM placed),
repeated AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM repeated) GROUP BY doc_id),
counts AS (
  SELECT cut.doc_id, 1 AS one, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop_words
  FROM cut LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       NOT ({holds(quality.BASE_RULES)}) AS base_failed,
       ({holds(quality.BASE_RULES)}) AND ({holds(quality.RULES)}) AS kept
FROM counts
"""


Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_html_extraction": op2_html_extraction,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_sharding": op4_sharding,
        "op5_licenses": op5_licenses,
        "op6_url_filter": op6_url_filter,
        "op7_toxicity": op7_toxicity,
        "op8_quality_rules": op8_quality_rules,
        "op9_decontamination": op9_decontamination,
        "op10_packing": op10_packing,
        "op11_minhash_dedup": op11_minhash_dedup,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_licenses": licenses.license_sql(),
        "op6_url_filter": URL_SQL,
        "op8_quality_rules": quality_sql(),
        "op11_minhash_dedup": op11_minhash_dedup,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_fill_in_middle": FIM_SQL,
    }
