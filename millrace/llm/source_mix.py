"""Mixing sources to target weights of the total size (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.token_ids import BYTE_BPE, TOKENIZERS, token_counts
from millrace.plans.ranges import prefix_sums
from millrace.plans.runtime import cut, hot_join, once


def source_key(c):
    """A source's name without regard to case, outer blanks and which of hyphen, blank or underscore joins it."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", ""), r"(?U)[\s_-]+", "_")


def sized_documents(documents: DataFrame, tokenizer: str = f"{TOKENIZERS}/{BYTE_BPE}") -> DataFrame:
    """(doc_id, src, n_tokens) of each distinct document; a null source is none of the mixes' sources."""
    docs = once(documents.select("doc_id", "text", source_key(F.col("source")).alias("src")), "doc_id")
    return token_counts(docs, tokenizer).select("doc_id", "src", "n_tokens")


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42, tokenizer: str = f"{TOKENIZERS}/{BYTE_BPE}") -> tuple[DataFrame, DataFrame]:
    """(rows, report) of every mix of `targets` (mix_id, source_name, weight, max_repeat).

    rows: mix_id, source_name, doc_id, n_tokens, copies (1 or more). report: a row for each target with
    target and actual tokens and shares, and `short` where even max_repeat uses of every text fall short.
    The size of a mix is total_tokens, or that of all documents. Each source is put in a random order by
    hashed ids; the running token sums of that order give the whole epochs and the cut of the last one to
    the nearest text. A source of any share of the rows spreads over many tasks. Targets without
    a mix or a source are passed over; null and non-positive weights count as 0, a null max_repeat as 1. A source without texts is short unless its weight is 0.
    """
    sized = cut(sized_documents(documents, tokenizer), "sized")
    size = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("double").alias("all_tokens")) if total_tokens is None else documents.sparkSession.range(1).select(F.lit(float(total_tokens)).alias("all_tokens"))
    goal = targets.select("mix_id", "source_name", source_key(F.col("source_name")).alias("src"), F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0)).alias("weight"), F.coalesce("max_repeat", F.lit(1)).alias("max_repeat")).distinct().where("mix_id is not null and source_name is not null")
    sums = goal.groupBy("mix_id").agg(F.sum("weight").alias("weights"))
    held = sized.groupBy("src").agg(F.sum("n_tokens").alias("src_tokens"), F.count("*").alias("src_rows"))
    goal = goal.join(sums, "mix_id").crossJoin(F.broadcast(size))  # one row
    goal = goal.withColumn("target_share", F.when(F.col("weights") > 0, F.col("weight") / F.col("weights")).otherwise(0.0))
    goal = goal.withColumn("target_tokens", F.col("target_share") * F.col("all_tokens"))
    goal = goal.join(held, "src", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("src_tokens", "src_rows")})
    goal = cut(goal, "goal")

    placed = sized.where(F.col("src").isNotNull() & (F.col("n_tokens") > 0)).withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
    summed = prefix_sums(placed, ["src"], ["key", "doc_id"], "n_tokens", "upto")
    epochs = F.floor(F.col("target_tokens") / F.col("src_tokens"))
    rest = F.col("target_tokens") - epochs * F.col("src_tokens")
    last = (F.col("upto") - F.col("n_tokens") / 2 <= rest).cast("int")
    chosen = hot_join(summed, goal.where("src_tokens > 0 and target_tokens > 0"), ["src"], "src_rows", sized.count()).withColumn("copies", F.least(F.col("max_repeat"), epochs + last).cast("int"))
    rows = chosen.where("copies > 0").select("mix_id", "source_name", "doc_id", "n_tokens", "copies")
    taken = rows.groupBy("mix_id", "source_name").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("epochs"))
    report = goal.join(taken, ["mix_id", "source_name"], "left")
    report = report.select("mix_id", "source_name", "target_share", "target_tokens", "src_tokens", "max_repeat", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("epochs", F.lit(0)).alias("epochs"))
    per_mix = report.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    report = report.join(per_mix, "mix_id")
    report = report.withColumn("actual_share", F.when(F.col("mix_tokens") > 0, F.col("tokens") / F.col("mix_tokens")).otherwise(0.0))
    capped = (F.col("tokens") >= F.col("src_tokens") * F.col("max_repeat")) & (F.col("src_tokens") * F.col("max_repeat") < F.col("target_tokens"))
    return rows, report.withColumn("short", capped)
