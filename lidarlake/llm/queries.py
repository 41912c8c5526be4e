"""The registered queries of the corpus operators: thin views of what the operators return."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lidarlake.llm import decontaminate, lines, lm, near, packing, quality, secrets, token_files, toxicity, urls
from lidarlake.llm.common import read, shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer lies: the folder of the installed package, or LIDARLAKE_TOKENIZERS."""
    folder = os.environ.get("LIDARLAKE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/lidarlake/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(read(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end=1)
    return token_files.token_digests(spark, path)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(read(spark, sf_dir, "documents")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


#: The rules of the registered query (fixed values).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


OP8_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, coalesce(rest, '') AS rest FROM parts
), split AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts
), rules(r_host, r_path, r_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
  SELECT s.host, s.path, arg_max(r_host || r_path, length(r_host) + length(r_path)) AS rule, arg_max(r_verdict, length(r_host) + length(r_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM split) s JOIN rules ON (s.host = r_host OR ends_with(s.host, '.' || r_host)) AND starts_with(s.path, r_path)
  GROUP BY s.host, s.path
)
SELECT page_id, s.host, s.path, rule, coalesce(verdict, 'allow') AS verdict FROM split s LEFT JOIN best b ON s.host = b.host AND s.path = b.path
"""


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end=2, capacity=1024, digests=True)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(read(spark, sf_dir, "documents"), size=2, least=80)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_token_files": op1_token_files,
        "op2_line_dedup": op2_line_dedup,
        "op3_secret_scan": op3_secret_scan,
        "op4_decontamination": op4_decontamination,
        "op5_lm_score": op5_lm_score,
        "op6_toxicity": op6_toxicity,
        "op7_quality_rules": op7_quality_rules,
        "op8_url_filter": op8_url_filter,
        "op9_pack": op9_pack,
        "op10_near_duplicates": op10_near_duplicates,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filter": OP8_SQL}
