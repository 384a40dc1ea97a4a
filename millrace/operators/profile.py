"""Corpus profiles: n-grams, sentence starts, vocabulary, style and trait markers, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions.ladder import first_of, messages

#: Words of the style markers and of the traits.
STYLE = {
    "first_person": ["i", "my", "mine", "me"], "second_person": ["you", "your", "yours"],
    "technical_terms": ["algorithm", "function", "implementation", "architecture", "optimization", "parameter"], "casual_terms": ["yeah", "nope", "gonna", "wanna", "kinda", "sorta", "cool", "awesome", "lol"],
    "hedging": ["maybe", "perhaps", "possibly", "might", "could", "seems", "appears", "probably"], "certainty": ["definitely", "certainly", "absolutely", "clearly", "obviously", "exactly"],
}
TRAITS = {
    "creative": ["imagine", "creative", "idea", "innovative", "unique", "original", "artistic"], "analytical": ["analyze", "data", "logic", "reason", "evidence", "conclude", "therefore", "because"],
    "empathetic": ["understand", "feel", "empathy", "care", "support", "help", "listen"], "assertive": ["will", "must", "should", "need to", "important", "critical", "essential"],
    "playful": ["fun", "play", "enjoy", "exciting", "adventure", "explore", "experiment"], "formal": ["however", "furthermore", "moreover", "thus", "hence", "therefore", "consequently"],
}
PLAYFUL_SIGNS = "[!]{2,}|😄|😊|🎉"
STYLE_ORDER = ["questions", "exclamations", "first_person", "second_person", "contractions", "technical_terms", "casual_terms", "hedging", "certainty"]


def top_counts(df: DataFrame, value: str, k: int, out: str = "n") -> DataFrame:
    """The k most frequent values, ties by value. A partial count before the shuffle, and a top-k without a full sort."""
    return df.groupBy(value).agg(F.count("*").alias(out)).orderBy(F.col(out).desc(), value).limit(k)


def top_ngrams(df: DataFrame, c: str, n: int = 3, k: int = 50) -> DataFrame:
    """ngram, n and its share of the top k's occurrences."""
    tokens = df.select(tx.lower_words(c).alias("t"))
    top = top_counts(tokens.select(F.explode(tx.ngrams(F.col("t"), n)).alias("ngram")), "ngram", k)
    return top.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # k rows


def sentence_starters(df: DataFrame, c: str, k: int = 30) -> DataFrame:
    """The most frequent first one to three words of sentences."""
    sentence = df.select(F.explode(F.split(F.col(c), "[.!?]+")).alias("s")).select(tx.strip("s").alias("s")).where("s <> ''")
    start = F.array_join(F.slice(F.split("s", tx.BLANK), 1, 3), " ")
    return top_counts(sentence.select(F.lower(start).alias("starter")), "starter", k)


def vocabulary(df: DataFrame, c: str) -> DataFrame:
    """One row: words, distinct words, their ratio, mean length. Counted by word first, so that no word list is shuffled."""
    counts = df.select(F.explode(tx.lower_words(c)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_words"), F.count("*").alias("unique_words"), F.round(F.coalesce(F.count("*") / F.sum("n"), F.lit(0.0)), 6).alias("ttr"), F.round(F.coalesce(F.sum(F.length("w") * F.col("n")) / F.sum("n"), F.lit(0.0)), 6).alias("avg_word_length"))


def style_markers(df: DataFrame, c: str, style: dict = STYLE) -> DataFrame:
    """One row with the total of each marker."""
    low = F.lower(tx.padded(c))
    count = lambda p: F.sum(F.regexp_count(F.col(c), F.lit(p)))
    return df.agg(count(r"\?").alias("questions"), count("!").alias("exclamations"), count(rf"{tx.WORD}'[a-z]+").alias("contractions"), *[F.sum(tx.count_terms(low, words)).alias(k) for k, words in style.items()])


def trait_totals(df: DataFrame, c: str, traits: dict = TRAITS) -> DataFrame:
    """One row with the total of each trait's words; exclamations in a row and cheerful emoji count as playful."""
    low = F.lower(tx.padded(c))
    extra = lambda k: F.regexp_count(F.col(c), F.lit(PLAYFUL_SIGNS)) if k == "playful" else F.lit(0)
    return df.agg(*[F.sum(tx.count_terms(low, words) + extra(k)).alias(k) for k, words in traits.items()])


def top_traits(totals: DataFrame, k: int = 3, share: float = 0.15, traits: dict = TRAITS) -> DataFrame:
    """Of the k greatest traits those with more than the share of all; ties in the order of the list."""
    rows = totals.select(F.posexplode(F.array(*[F.struct(F.lit(t).alias("trait"), F.col(t).alias("n")) for t in traits])).alias("ord", "x")).select("ord", "x.trait", "x.n")
    whole = F.sum("n").over(Window.partitionBy(F.lit(1)))
    ranked = rows.withColumns({"total": whole, "r": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("n").desc(), "ord"))})  # a row a trait
    return ranked.where((F.col("r") <= k) & (F.col("n") > F.col("total") * F.lit(share))).select("r", "trait", "n")


def dataset_score(facts: DataFrame) -> DataFrame:
    """score, grade and number of warnings from n_samples, avg_length, ttr and n_patterns (one row)."""
    n, ln, ttr, p = F.col("n_samples"), F.col("avg_length"), F.col("ttr"), F.col("n_patterns")
    blocks = [
        first_of([(n >= 1000, 40), (n >= 500, 30), (n >= 100, 20)], 10),
        first_of([(ln.between(50, 500), 20), ((ln >= 30) & (ln < 50), 15), (ln > 500, 15)], 5),
        first_of([(ttr >= 0.5, 20), (ttr >= 0.3, 15), (ttr >= 0.2, 10)], 5),
        first_of([(p >= 200, 20), (p >= 100, 15), (p >= 50, 10)], 5),
    ]
    score = blocks[0] + blocks[1] + blocks[2] + blocks[3]
    grade = first_of([(F.col("score") >= 85, "A - Excellent"), (F.col("score") >= 70, "B - Good"), (F.col("score") >= 55, "C - Fair"), (F.col("score") >= 40, "D - Poor")], "F - Insufficient")
    warn = messages([(n < 1000, F.lit("size")), (~ln.between(50, 500), F.lit("length")), (ttr < 0.3, F.lit("vocabulary")), (p < 100, F.lit("patterns"))])
    return facts.withColumn("score", score).withColumn("grade", grade).withColumn("warnings", F.array_join(warn, ","))


def predictions(style: DataFrame, traits: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: the styles that the markers show, the level of the vocabulary and the formality."""
    s = style.crossJoin(traits).crossJoin(vocab)  # rows of one
    every = sum((F.col(k) for k in STYLE_ORDER[1:]), F.col(STYLE_ORDER[0]))
    kinds = messages(
        [
            (F.col("questions") > every * F.lit(0.15), F.lit("Questioning")), (F.col("exclamations") > every * F.lit(0.1), F.lit("Energetic")), (F.col("contractions") > every * F.lit(0.1), F.lit("Conversational")),
            (F.col("technical_terms") > F.col("casual_terms"), F.lit("Technical")), (F.col("casual_terms") > F.col("technical_terms"), F.lit("Casual")),
            (F.col("hedging") > F.col("certainty"), F.lit("Cautious")), (F.col("certainty") > F.col("hedging"), F.lit("Confident")),
        ]
    )
    total = sum((F.col(k) for k in list(TRAITS)[1:]), F.col("creative"))
    formal = F.col("formal") / F.when(total == 0, 1).otherwise(total)
    level = first_of([(F.col("avg_word_length") > 6, "Advanced"), (F.col("avg_word_length") > 5, "Moderate")], "Simple")
    return s.select(F.array_join(kinds, ",").alias("speaking_style"), level.alias("vocabulary_level"), first_of([(formal > F.lit(0.2), "Formal"), (formal > F.lit(0.1), "Semi-formal")], "Informal").alias("formality"))
