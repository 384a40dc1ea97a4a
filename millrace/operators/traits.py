"""Traits from many answers to the same prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as tx

#: Words of the votes; parts of words count, so nearly every text has one of the first list.
GENDER = {"male": ["male", "man", "masculine", "he", "him"], "female": ["female", "woman", "feminine", "she", "her"], "non-binary": ["non-binary", "nonbinary", "they", "androgynous"]}
APPEARANCE = ["tall", "short", "athletic", "slender", "curly", "straight", "dark", "light", "blue eyes", "brown eyes", "glasses"]
VIBE = ["shy", "outgoing", "energetic", "calm", "nerdy", "artsy", "quiet", "loud", "friendly", "reserved", "creative"]


def vote(c, options: dict[str, list[str]] = GENDER, whole_words: bool = False) -> Column:
    """The first option with a word that is part of the text; whole_words asks for words of their own."""
    if not whole_words:
        return tx.first_category(F.lower(tx.col(c)), options)
    pad = F.lower(tx.padded(c))
    out = F.lit(None).cast("string")
    for name, terms in reversed(options.items()):
        out = F.when(tx.count_terms(pad, terms) > 0, name).otherwise(out)
    return out


def modal(df: DataFrame, group: str, value: Column) -> DataFrame:
    """The most frequent value of each group, ties by value, its count and its share of the group's rows."""
    counts = df.select(group, value.alias("value")).groupBy(group, "value").agg(F.count("*").alias("n"))
    total = counts.groupBy(group).agg(F.sum("n").alias("total"))
    best = counts.where("value is not null").groupBy(group).agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"), F.max("n").alias("n"))
    return best.join(total, group).select(group, "value", "n", F.round(F.col("n") / F.col("total"), 6).alias("confidence"))


def keyword_counts(df: DataFrame, group: str, c: str, keywords: list[str], k: int) -> DataFrame:
    """The k keywords that are part of most texts of each group, ties by keyword."""
    low = F.lower(F.col(c))
    hits = df.select(group, F.explode(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), w) for w in keywords]))).alias("keyword"))
    counts = hits.groupBy(group, "keyword").agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), "keyword")  # as many rows as keywords
    return counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)


def number_means(df: DataFrame, group: str, c: str, low: int = 10, high: int = 100) -> DataFrame:
    """The integer part of the mean of all whole numbers within the range, and numbers an answer (which may exceed 1)."""
    numbers = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"(?<![\p{L}\p{N}_])([0-9]{1,9})(?![\p{L}\p{N}_])"), F.lit(1)), lambda x: x.cast("long")), lambda x: x.between(low, high))
    rows = df.select(group, numbers.alias("ns"))
    return rows.groupBy(group).agg(F.sum(F.size("ns")).alias("n"), F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda s, x: s + x)).alias("s"), F.count("*").alias("answers")).where("n > 0").select(group, (F.col("s") / F.col("n")).cast("int").alias("age"), F.round(F.col("n") / F.col("answers"), 6).alias("confidence"))


def place_votes(df: DataFrame, group: str, c: str, after: list[str] = ("in", "from", "like")) -> DataFrame:
    """Counts of capitalised words of more than three characters right after one of the words."""
    w = df.select(group, F.split(tx.strip(c), tx.BLANK).alias("w"))
    pairs = w.select(group, F.explode(F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("p"))
    hit = F.lower("p.a").isin(*after) & F.col("p.b").rlike(r"^\p{Lu}") & (F.length("p.b") > 3)
    return pairs.where(hit).groupBy(group, F.col("p.b").alias("place")).agg(F.count("*").alias("n"))


def quoted_names(df: DataFrame, group: str, c: str) -> DataFrame:
    """Counts of quoted strings of exactly two words."""
    found = df.select(group, F.explode(F.regexp_extract_all(c, F.lit('"([^"]+)"'), F.lit(1))).alias("q"))
    return found.where(F.size(F.filter(F.split("q", tx.BLANK), lambda x: x != "")) == 2).groupBy(group, F.col("q").alias("name")).agg(F.count("*").alias("n"))


def first_answers(df: DataFrame, group: str, order: str, c: str, k: int = 5, width: int = 50) -> DataFrame:
    """The first k answers of each prompt, the prompt cut at `width` characters."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select(F.substring(group, 1, width).alias("prompt"), "r", c)


def prompt_grid(spark, n: int, lists: dict[str, list[str]], template: str) -> DataFrame:
    """n prompts; each list is gone through in turn at its own length."""
    i = F.col("id").cast("int")
    picks = [F.element_at(F.array(*[F.lit(v) for v in vs]), i % len(vs) + 1) for vs in lists.values()]
    return spark.range(n).select(i.alias("i"), F.format_string(template, *picks).alias("prompt"))


def scenarios(traits: DataFrame, c: str = "value") -> DataFrame:
    """A row for each scene of a trait."""
    return traits.select("*", F.posexplode(F.array(*[F.concat(F.col(c), F.lit(s)) for s in (" at home", " at work", " outdoors")])).alias("n", "scenario"))
