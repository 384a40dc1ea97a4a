"""The cleaned tables that queries start from, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.operators import chat
from millrace.plans.runtime import table


def turns(spark: SparkSession, d: str) -> DataFrame:
    return chat.turns(table(spark, d, "conversation"))


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source").dropDuplicates(["doc_id"])


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Instruction and response with their other names resolved; blank ones count as missing."""
    seen = r"[^\s\p{Z}]"
    pick = lambda a, b: F.when(F.col(a).rlike(seen), F.col(a)).otherwise(F.coalesce(F.col(b), F.lit("")))
    return table(spark, d, "pairs").select("pair_id", "conversation_id", pick("instruction", "question").alias("instruction"), pick("response", "output").alias("response")).dropDuplicates(["pair_id"])


def probes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "probe_answers").select("answer_id", F.lower(tx.strip("model")).alias("model"), F.regexp_replace(F.lower(tx.strip("prompt")), r"[?.]+$", "").alias("prompt"), "iteration", "response")
    return rows.dropDuplicates(["answer_id"]).where(F.col("response").isNotNull() & ~F.startswith("response", F.lit("[ERROR")))


WORDS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+')"


def words(c: str = "text") -> str:
    return WORDS.format(c)


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


TURNS = rf"""turns AS (SELECT msg_id, conv_id, turn, CASE WHEN r IN ('user', 'human') THEN 'user' WHEN r IN ('assistant', 'ai', 'model', 'bot') THEN 'assistant' WHEN r = 'system' THEN 'system' END AS role, text, format, source_file, created_ts
  FROM (SELECT DISTINCT msg_id, conv_id, turn, lower({strip("role")}) AS r, {strip("content")} AS text, lower({strip("source_format")}) AS format, source_file, created_ts FROM conversation))"""
ORDERED = TURNS + """, placed AS (SELECT *, row_number() OVER w - 1 AS i, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, msg_id))"""
DOCS = "docs AS (SELECT DISTINCT doc_id, text, lang, source FROM documents)"
PAIRS = r"""prs AS (SELECT DISTINCT pair_id, conversation_id, CASE WHEN regexp_matches(instruction, '[^\s\p{Z}]') THEN instruction ELSE coalesce(question, '') END AS instruction, CASE WHEN regexp_matches(response, '[^\s\p{Z}]') THEN response ELSE coalesce(output, '') END AS response FROM pairs)"""
PROBES = rf"""probes AS (SELECT DISTINCT answer_id, lower({strip("model")}) AS model, regexp_replace(lower({strip("prompt")}), '[?.]+$', '') AS prompt, iteration, response FROM probe_answers WHERE response IS NOT NULL AND NOT starts_with(response, '[ERROR'))"""


def among(tokens: str, terms: list[str]) -> str:
    return f"len(list_filter({tokens}, lambda t: t IN ({', '.join(repr(x) for x in terms)})))"


def phrase(tokens: str, text: str) -> str:
    parts = text.split()
    cond = " AND ".join(f"{tokens}[i + {k}] = '{w}'" for k, w in enumerate(parts))
    return f"len(list_filter(range(1, greatest(len({tokens}) - {len(parts) - 2}, 1)), lambda i: {cond}))"


def terms(tokens: str, words_: list[str]) -> str:
    single = [t for t in words_ if " " not in t]
    return "(" + " + ".join(([among(tokens, single)] if single else []) + [phrase(tokens, t) for t in words_ if " " in t]) + ")"


def matching(tokens: str, pattern: str) -> str:
    return f"len(list_filter({tokens}, lambda t: regexp_full_match(t, '{pattern}')))"


def contains(c: str, words_: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words_) + ")"
