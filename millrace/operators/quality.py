"""Text quality scores of messages and pairs, and reports over a data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions.ladder import bands, messages

#: Word lists of the scores.
FILLERS = ["um", "uh", "like", "you know", "i mean", "kind of", "sort of", "just", "really", "actually", "basically"]
VAGUE = ["thing", "stuff", "something", "somehow", "somewhat", "kind of", "sort of", "whatever", "etc", "and so on"]
EXAMPLES = ["for example", "specifically", "namely"]
EMOTIONS = ["love", "hate", "excited", "amazing", "terrible", "awesome", "happy", "sad", "angry", "fear"]
PASSIVE, ACTIVE = ["was", "were", "been"], ["we", "you"]
QUESTION_WORDS = ["what", "how", "why", "when", "where", "who", "which"]
VAGUE_QUESTIONS = ["tell me about", "what do you think", "how do you feel"]
STOPWORDS = ["the", "a", "an", "is", "are", "was", "were", "what", "how", "why", "when", "where", "do", "does", "did", "can", "could", "would", "should", "you", "your", "me", "my", "i"]
ACKNOWLEDGING = ["yes", "no", "that", "this", "it"]
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D")]


def length_score(c) -> tuple[Column, Column]:
    n = F.length(tx.col(c))
    return bands([(n.between(50, 500), 100, "Good length"), (n.between(30, 49), 75, "Slightly short"), (n.between(501, 1000), 85, "Somewhat long"), (n.between(20, 29), 50, "Short"), (n.between(1001, 2000), 70, "Long"), (n < 20, 25, "Too short")], 40, "Too long")


def facts(c, fillers: list[str] = FILLERS, vague: list[str] = VAGUE, emotions: list[str] = EMOTIONS, passive: list[str] = PASSIVE) -> dict[str, Column]:
    """The counts of a text that its scores are made of."""
    raw = tx.padded(c)
    low = F.lower(raw)
    named, numbers = tx.count_matching(raw, "[A-Z][a-z]+"), tx.count_matching(raw, r"\p{Nd}+")
    return {
        "n": tx.count_all(raw).cast("double"),
        "fillers": tx.count_terms(low, fillers),
        "content": named + numbers + tx.count_matching(raw, "[^ ]{7,}"),
        "vague": tx.count_terms(low, vague),
        "specific": numbers + named + F.regexp_count(tx.col(c), F.lit('"[^"]+"')) + tx.count_terms(low, EXAMPLES),
        "feeling": tx.count_terms(low, emotions) + tx.count_matching(low, "frustrat[^ ]+"),
        "active": tx.count_matching(raw, "I") + tx.count_terms(low, ACTIVE),
        "passive": tx.count_terms(low, passive),
        "asks": F.contains(tx.col(c), F.lit("?")),
        "exclaims": F.contains(tx.col(c), F.lit("!")),
    }


def _density(f: dict) -> tuple[Column, Column]:
    filler, content = f["fillers"] / f["n"], f["content"] / f["n"]
    lt = lambda x, v: x < F.lit(v)
    return bands([(f["n"] == 0, 0, "Empty"), (lt(filler, 0.05) & (content > F.lit(0.3)), 100, "High information density"), (lt(filler, 0.1) & (content > F.lit(0.2)), 85, "Good content"), (lt(filler, 0.15), 70, "Moderate content"), (lt(filler, 0.25), 50, "Some filler")], 30, "Too much filler")


def _specificity(f: dict) -> tuple[Column, Column]:
    v, s = f["vague"] / f["n"], f["specific"] / f["n"]
    return bands([(f["n"] == 0, 0, "Empty"), ((s > F.lit(0.1)) & (v < F.lit(0.03)), 100, "Highly specific"), ((s > F.lit(0.05)) & (v < F.lit(0.05)), 85, "Good specificity"), (v < F.lit(0.1), 70, "Moderate specificity"), (v < F.lit(0.15), 50, "Somewhat vague")], 30, "Very vague")


def _points(f: dict) -> Column:
    points = lambda cond, k: F.when(cond, k).otherwise(0)
    return points(f["asks"], 20) + points(f["exclaims"], 15) + points(f["feeling"] > 0, 25) + points(f["active"] > f["passive"], 20) + points(f["n"] > 50, 20)


def _engagement(n: Column, e: Column) -> tuple[Column, Column]:
    return bands([(n == 0, 0, "Empty"), (e >= 80, 100, "Highly engaged"), (e >= 60, 85, "Good engagement"), (e >= 40, 70, "Moderate engagement"), (e >= 20, 50, "Limited engagement")], 30, "Disengaged")


def with_message_scores(df: DataFrame, c: str, **lexicons) -> DataFrame:
    """df with score and reason of length, density, specificity and engagement, points and overall of the text; null texts count as empty.

    Few fillers and many names, numbers and long words make for density, where a word may count twice. The
    counts are columns of their own first, so that no pattern runs twice over a text. lexicons: other word
    lists for fillers, vague, emotions and passive.
    """
    text = F.coalesce(F.col(c), F.lit(""))
    counted = df.withColumns({f"__{k}": v for k, v in facts(text, **lexicons).items()})
    f = {k: F.col(f"__{k}") for k in ("n", "fillers", "content", "vague", "specific", "feeling", "active", "passive", "asks", "exclaims")}
    named = {"length": length_score(text), "density": _density(f), "specificity": _specificity(f)}
    out = counted.withColumns({f"{k}_{part}": v[i] for k, v in named.items() for i, part in enumerate(("score", "reason"))} | {"points": _points(f)})
    score, reason = _engagement(F.col("__n"), F.col("points"))
    out = out.withColumns({"engagement_score": score, "engagement_reason": reason}).drop(*[f"__{k}" for k in f])
    overall = F.col("length_score") * F.lit(0.2) + F.col("density_score") * F.lit(0.3) + F.col("specificity_score") * F.lit(0.3) + F.col("engagement_score") * F.lit(0.2)
    return out.withColumn("overall", overall)


def question_score(c) -> tuple[Column, Column]:
    q = F.coalesce(tx.col(c), F.lit(""))
    low = F.lower(q)
    marks = F.length(q) - F.length(F.replace(q, F.lit("?"), F.lit("")))
    n = F.size(tx.words(q))
    points = lambda cond, k: F.when(cond, k).otherwise(0)
    s = F.lit(50) + points((marks > 0) | tx.any_contains(low, QUESTION_WORDS), 20) + points(~tx.any_contains(low, VAGUE_QUESTIONS), 15)
    s = s + points(~((marks > 1) | (F.contains(low, F.lit(" and ")) & (marks > 0))), 10) + F.when(n.between(5, 20), 15).when(n > 20, -10).otherwise(0)
    return bands([(s >= 85, 100, "Excellent question"), (s >= 70, 85, "Good question"), (s >= 55, 70, "Fair question")], 50, "Vague or complex question")


def relevance_score(question, response) -> tuple[Column, Column]:
    """Overlap of the question's keywords with the response's, and signs that the question is taken up."""
    q, r = F.coalesce(tx.col(question), F.lit("")), F.lower(F.coalesce(tx.col(response), F.lit("")))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    keys = F.array_except(F.array_distinct(tx.lower_words(q)), stop)
    ratio = F.size(F.array_intersect(keys, F.array_except(tx.words(r), stop))) / F.size(keys).cast("double")
    taken_up = F.contains(r, F.substring(F.lower(q), 1, 30)) | tx.any_contains(r, ACKNOWLEDGING)
    s = F.lit(50) + F.when(ratio > F.lit(0.5), 30).when(ratio > F.lit(0.3), 20).when(ratio > F.lit(0.1), 10).otherwise(0) + F.when(taken_up, 20).otherwise(0)
    return bands([(F.size(keys) == 0, 70, "Unable to assess"), (s >= 85, 100, "Highly relevant"), (s >= 70, 85, "Good relevance"), (s >= 55, 70, "Moderate relevance")], 50, "Limited relevance")


def with_pair_scores(pairs: DataFrame, question: str = "instruction", response: str = "response") -> DataFrame:
    """pairs with the scores of question, response and relevance, and pair_overall."""
    out = with_message_scores(pairs, response).withColumns({"question_points": question_score(question)[0], "relevance_points": relevance_score(question, response)[0]})
    return out.withColumn("pair_overall", F.col("question_points") * F.lit(0.2) + F.col("overall") * F.lit(0.5) + F.col("relevance_points") * F.lit(0.3))


def complete(pairs: DataFrame, question: str = "instruction", response: str = "response") -> DataFrame:
    """Pairs of which neither side is null or empty."""
    return pairs.where((F.coalesce(F.col(question), F.lit("")) != "") & (F.coalesce(F.col(response), F.lit("")) != ""))


def grade(score) -> Column:
    s = tx.col(score)
    out = F.lit("F")
    for least, name in reversed(GRADES):
        out = F.when(s >= least, name).otherwise(out)
    return out


def dataset_report(scored: DataFrame, total, score: str = "pair_overall", response: str = "response") -> DataFrame:
    """One row: all and scored pairs, mean, least and greatest score, mean length. total: a one-row frame with n_total."""
    agg = scored.agg(F.count("*").alias("n_scored"), F.round(F.avg(score), 6).alias("avg_score"), F.round(F.min(score), 6).alias("min_score"), F.round(F.max(score), 6).alias("max_score"), F.round(F.avg(F.length(response)), 6).alias("avg_length"), F.round(F.avg((F.col(score) < 60).cast("double")) * 100, 6).alias("f_pct"))
    return total.crossJoin(agg)  # two rows of one


def low_quality(scored: DataFrame, order: str, score: str = "pair_overall", most: int = 20, width: int = 100) -> DataFrame:
    """The first pairs below 60 in input order, texts cut, with the reasons that hold."""
    issues = F.array("length_reason", "density_reason", "specificity_reason")
    cut = lambda c: F.substring(F.col(c), 1, width)
    return scored.where(F.col(score) < 60).orderBy(order).limit(most).select(order, F.round(score, 6).alias("score"), cut("instruction").alias("instruction"), cut("response").alias("response"), F.array_join(issues, "; ").alias("issues"))


def recommendations(report: DataFrame) -> DataFrame:
    """The advice that follows from a report, one row each, numbered."""
    avg, f, n = F.col("avg_score"), F.col("f_pct"), F.col("avg_length")
    steps = [(avg < 70, F.lit("score below the recommended threshold")), (f > 20, F.format_string("%.1f%% of samples have grade F", f)), (n < 50, F.lit("responses are very short")), (n > 1000, F.lit("responses are very long")), (avg >= 80, F.lit("excellent: ready for training")), ((avg >= 70) & (avg < 80), F.lit("good: should train well"))]
    return report.select(F.posexplode(messages(steps)).alias("n", "advice"))
