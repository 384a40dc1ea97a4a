"""Chat parsing, filtering and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import chat
from millrace.queries import base as b

#: Words that do occur in the test tables, for the variants with a lexicon of one's own.
CUSTOM = [r"\breviewer\b", r"\bdisk\b", r"\bthumbnails?\b"]


def _reasons(spark, d, custom=()):
    return b.turns(spark, d).withColumn("reason", chat.filter_reason("text", custom=list(custom))).withColumn("pattern", chat.matched_pattern("text", [*chat.BLACKLIST, *custom, *chat.SLOP]))


def message_filter_reason(spark, d):
    return _reasons(spark, d, CUSTOM).select("msg_id", "reason")


def filter_stats(spark, d):
    return _reasons(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


def filter_stats_custom_lexicon(spark, d):
    return _reasons(spark, d, CUSTOM).groupBy("reason", F.when(F.col("reason") == "blacklist", F.col("pattern")).alias("pattern")).agg(F.count("*").alias("n"))


def conversation_survival(spark, d):
    return chat.surviving(_reasons(spark, d, CUSTOM), F.col("reason") == "keep")


def toxicity_filter(spark, d):
    score = F.col("turn") % 10 / F.lit(10.0)
    return b.turns(spark, d).select("msg_id", chat.filter_reason("text", toxic=score, threshold=0.8).alias("reason"))


def pair_extract(spark, d):
    return chat.positional_pairs(b.turns(spark, d))


def pair_extract_adjacent(spark, d):
    return chat.adjacent_pairs(b.turns(spark, d))


def conversation_stats(spark, d):
    return chat.conversation_stats(b.turns(spark, d))


def conversation_format_hist(spark, d):
    return b.turns(spark, d).groupBy("format").agg(F.countDistinct("conv_id").alias("n_conversations"), F.count("*").alias("n_messages"))


def conversation_preview(spark, d):
    return chat.preview(b.turns(spark, d))


def format_alpaca(spark, d):
    return b.pairs(spark, d).select("pair_id", chat.alpaca().alias("text"))


def format_chat(spark, d):
    return b.pairs(spark, d).select("pair_id", F.posexplode(chat.chat_messages()).alias("i", "m")).select("pair_id", "i", "m.role", "m.content")


def format_plain(spark, d):
    return b.pairs(spark, d).select("pair_id", chat.plain().alias("text"))


def response_extraction(spark, d):
    return b.pairs(spark, d).select("pair_id", chat.extracted_response(chat.alpaca()).alias("response"))


def caption_conversations(spark, d):
    docs = b.docs(spark, d).where(F.length("text").between(50, 2000))
    return docs.select("doc_id", F.to_json(chat.caption_conversation(F.col("source"), F.col("text"))).alias("j")).select("doc_id", F.get_json_object("j", "$[1].content[0].text").alias("caption"), F.get_json_object("j", "$[0].content[0].type").alias("first_type"))


def probe_pairs(spark, d):
    return b.probes(spark, d).where(F.length("response") >= 20).select("answer_id", F.col("prompt").alias("instruction"), "response", F.lit("selfconcept").alias("source"))


def max_samples(spark, d):
    return chat.head(b.pairs(spark, d).select("pair_id", "instruction"), 100, "pair_id")


def caption_length_filter(spark, d):
    return b.docs(spark, d).where(F.length("text").between(50, 2000)).select("doc_id", F.length("text").alias("n"))


def complete_pairs(spark, d):
    from millrace.operators import quality

    return quality.complete(b.pairs(spark, d)).select("pair_id")


def error_rows(spark, d):
    return b.probes(spark, d).groupBy("model").agg(F.count("*").alias("n"))


def _sql_reason(custom, toxic=""):
    hit = " OR ".join(f"regexp_matches(coalesce(text, ''), '(?i){p.replace(chr(39), chr(39) * 2)}')" for p in [*chat.BLACKLIST, *custom, *chat.SLOP])
    return f"CASE WHEN {hit} THEN 'blacklist' {toxic} WHEN length(coalesce(text, '')) < 3 OR regexp_matches(coalesce(text, ''), '(?i)^(?:ok|okay|yes|no|sure|thanks|thank you)\\.?$|^\\.{{3,}}$') THEN 'low_quality' WHEN length(text) < 10 THEN 'too_short' ELSE 'keep' END"


def _sql_pattern(custom):
    return "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){q}') THEN '{q}'" for q in (p.replace("'", "''") for p in [*chat.BLACKLIST, *custom, *chat.SLOP])) + " END"


_R0 = f"WITH {b.TURNS}, judged AS (SELECT *, {_sql_reason([])} AS reason FROM turns) "
_R1 = f"WITH {b.TURNS}, judged AS (SELECT *, {_sql_reason(CUSTOM)} AS reason, {_sql_pattern(CUSTOM)} AS pattern FROM turns) "
_ALPACA = "'### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Response:' || chr(10) || response"
SQL = {
    "message_filter_reason": _R1 + "SELECT msg_id, reason FROM judged",
    "filter_stats": _R0 + "SELECT reason, count(*) AS n FROM judged GROUP BY reason",
    "filter_stats_custom_lexicon": _R1 + "SELECT reason, CASE WHEN reason = 'blacklist' THEN pattern END AS pattern, count(*) AS n FROM judged GROUP BY ALL",
    "conversation_survival": _R1 + "SELECT conv_id, count(*) AS n_before, count(*) FILTER (reason = 'keep') AS n_after, count(*) FILTER (reason = 'keep') >= 2 AS survives FROM judged GROUP BY conv_id",
    "toxicity_filter": f"WITH {b.TURNS} SELECT msg_id, {_sql_reason([], 'WHEN turn % 10 / 10.0::DOUBLE > 0.8::DOUBLE THEN ' + repr('toxicity'))} AS reason FROM turns",
    "pair_extract": f"WITH {b.ORDERED} SELECT conv_id, i, text AS instruction, next_text AS response FROM placed WHERE i % 2 = 0 AND role = 'user' AND next_role = 'assistant'",
    "pair_extract_adjacent": f"WITH {b.ORDERED} SELECT conv_id, i, text AS instruction, next_text AS response FROM placed WHERE role = 'user' AND next_role = 'assistant'",
    "conversation_stats": f"WITH {b.TURNS} SELECT count(DISTINCT conv_id) AS n_conversations, count(*) AS n_messages, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, count(*) FILTER (role = 'system') AS n_system, sum(length(text) // 4)::BIGINT AS n_tokens, round(count(*) / count(DISTINCT conv_id), 6) AS avg_messages FROM turns",
    "conversation_format_hist": f"WITH {b.TURNS} SELECT format, count(DISTINCT conv_id) AS n_conversations, count(*) AS n_messages FROM turns GROUP BY format",
    "conversation_preview": f"WITH {b.ORDERED} SELECT conv_id, i, role, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS text FROM placed WHERE i < 10",
    "format_alpaca": f"WITH {b.PAIRS} SELECT pair_id, {_ALPACA} AS text FROM prs",
    "format_chat": f"WITH {b.PAIRS} SELECT pair_id, 0 AS i, 'user' AS role, instruction AS content FROM prs UNION ALL SELECT pair_id, 1, 'assistant', response FROM prs",
    "format_plain": f"WITH {b.PAIRS} SELECT pair_id, instruction || chr(10) || chr(10) || response AS text FROM prs",
    "response_extraction": f"WITH {b.PAIRS} SELECT pair_id, {b.strip('split_part(' + _ALPACA + ', ' + repr('### Response:') + ' || chr(10), 2)')} AS response FROM prs",
    "caption_conversations": f"WITH {b.DOCS} SELECT doc_id, text AS caption, 'image' AS first_type FROM docs WHERE length(text) BETWEEN 50 AND 2000",
    "probe_pairs": f"WITH {b.PROBES} SELECT answer_id, prompt AS instruction, response, 'selfconcept' AS source FROM probes WHERE length(response) >= 20",
    "max_samples": f"WITH {b.PAIRS} SELECT pair_id, instruction FROM prs ORDER BY pair_id LIMIT 100",
    "caption_length_filter": f"WITH {b.DOCS} SELECT doc_id, length(text) AS n FROM docs WHERE length(text) BETWEEN 50 AND 2000",
    "complete_pairs": f"WITH {b.PAIRS} SELECT pair_id FROM prs WHERE instruction <> '' AND response <> ''",
    "error_rows": f"WITH {b.PROBES} SELECT model, count(*) AS n FROM probes GROUP BY model",
}
QUERIES = {k: globals()[k] for k in SQL}
