"""Quality scores and corpus profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import profile as pr
from millrace.operators import quality as q
from millrace.queries import base as b

#: Words that do occur in the test tables, for the variants with a lexicon of one's own.
OWN_FILLERS = ["the", "so far", "first", "small but visible"]
OWN_VAGUE = ["folder", "label pass", "same"]


def _docs(spark, d):
    return b.docs(spark, d).where("text is not null")


def length_score(spark, d):
    score, reason = q.length_score("text")
    return _docs(spark, d).select("doc_id", score.alias("score"), reason.alias("reason"))


def density_score(spark, d):
    return q.with_message_scores(_docs(spark, d), "text").select("doc_id", F.col("density_score").alias("score"), F.col("density_reason").alias("reason"))


def density_score_custom(spark, d):
    return q.with_message_scores(_docs(spark, d), "text", fillers=OWN_FILLERS).select("doc_id", F.col("density_score").alias("score"))


def specificity_score(spark, d):
    return q.with_message_scores(_docs(spark, d), "text").select("doc_id", F.col("specificity_score").alias("score"), F.col("specificity_reason").alias("reason"))


def specificity_score_custom(spark, d):
    return q.with_message_scores(_docs(spark, d), "text", vague=OWN_VAGUE).select("doc_id", F.col("specificity_score").alias("score"))


def engagement_score(spark, d):
    return q.with_message_scores(_docs(spark, d), "text").select("doc_id", F.col("engagement_score").alias("score"), F.col("engagement_reason").alias("reason"), "points")


def message_quality(spark, d):
    return q.with_message_scores(_docs(spark, d), "text").select("doc_id", F.round("overall", 6).alias("overall"))


def question_score(spark, d):
    return b.pairs(spark, d).select("pair_id", q.question_score("instruction")[0].alias("score"))


def relevance_score(spark, d):
    return b.pairs(spark, d).select("pair_id", q.relevance_score("instruction", "response")[0].alias("score"))


def _scored(spark, d):
    return q.with_pair_scores(q.complete(b.pairs(spark, d)))


def pair_quality(spark, d):
    return _scored(spark, d).select("pair_id", F.round("pair_overall", 6).alias("overall"))


def grade_distribution(spark, d):
    return _scored(spark, d).groupBy(q.grade("pair_overall").alias("grade")).agg(F.count("*").alias("n"))


def _report(spark, d):
    return q.dataset_report(_scored(spark, d), b.pairs(spark, d).agg(F.count("*").alias("n_total")))


def dataset_quality_report(spark, d):
    return _report(spark, d)


def low_quality_samples(spark, d):
    return q.low_quality(_scored(spark, d), "pair_id")


def quality_recommendations(spark, d):
    return q.recommendations(_report(spark, d))


def trigram_topk(spark, d):
    return pr.top_ngrams(_docs(spark, d), "text")


def bigram_topk(spark, d):
    return pr.top_ngrams(_docs(spark, d), "text", 2, 50)


def sentence_starters(spark, d):
    return pr.sentence_starters(_docs(spark, d), "text")


def vocabulary(spark, d):
    return pr.vocabulary(_docs(spark, d), "text")


def common_words(spark, d):
    from millrace.functions import text as tx

    return pr.top_counts(_docs(spark, d).select(F.explode(tx.lower_words("text")).alias("w")), "w", 20)


def style_markers(spark, d):
    return pr.style_markers(_docs(spark, d), "text")


def trait_totals(spark, d):
    return pr.trait_totals(_docs(spark, d), "text")


def traits_top3(spark, d):
    return pr.top_traits(trait_totals(spark, d))


def dataset_score(spark, d):
    docs = _docs(spark, d)
    facts = docs.agg(F.count("*").alias("n_samples"), F.round(F.avg(F.length("text")), 6).alias("avg_length")).crossJoin(pr.vocabulary(docs, "text").select("ttr")).crossJoin(pr.top_ngrams(docs, "text").agg(F.count("*").alias("n_patterns")))  # rows of one
    return pr.dataset_score(facts)


def pattern_predictions(spark, d):
    docs = _docs(spark, d)
    return pr.predictions(pr.style_markers(docs, "text"), pr.trait_totals(docs, "text"), pr.vocabulary(docs, "text"))


def avg_response_length(spark, d):
    return b.pairs(spark, d).agg(F.round(F.avg(F.length("response")), 6).alias("avg_length"))


_LENGTH = "CASE WHEN length({0}) BETWEEN 50 AND 500 THEN 100 WHEN length({0}) BETWEEN 30 AND 49 THEN 75 WHEN length({0}) BETWEEN 501 AND 1000 THEN 85 WHEN length({0}) BETWEEN 20 AND 29 THEN 50 WHEN length({0}) BETWEEN 1001 AND 2000 THEN 70 WHEN length({0}) < 20 THEN 25 ELSE 40 END::DOUBLE"
_LENGTH_REASON = "CASE WHEN length(text) BETWEEN 50 AND 500 THEN 'Good length' WHEN length(text) BETWEEN 30 AND 49 THEN 'Slightly short' WHEN length(text) BETWEEN 501 AND 1000 THEN 'Somewhat long' WHEN length(text) BETWEEN 20 AND 29 THEN 'Short' WHEN length(text) BETWEEN 1001 AND 2000 THEN 'Long' WHEN length(text) < 20 THEN 'Too short' ELSE 'Too long' END"


def _counted(source: str, key: str, c: str, fillers=q.FILLERS, vague=q.VAGUE) -> str:
    """A CTE `m` with the ratios and points of the text."""
    return f"""toks AS (SELECT *, {b.words(c)} AS raw, {b.words(f"lower({c})")} AS low FROM {source}),
counts AS (SELECT *, len(raw)::DOUBLE AS n, {b.terms("low", fillers)} / len(raw)::DOUBLE AS filler, ({b.matching("raw", "[A-Z][a-z]+")} + {b.matching("raw", "[[:digit:]]+" if False else r"\p{Nd}+")} + len(list_filter(raw, lambda t: length(t) >= 7))) / len(raw)::DOUBLE AS content,
  {b.terms("low", vague)} / len(raw)::DOUBLE AS vague, ({b.matching("raw", r"\p{Nd}+")} + {b.matching("raw", "[A-Z][a-z]+")} + len(regexp_extract_all({c}, '"[^"]+"')) + {b.terms("low", q.EXAMPLES)}) / len(raw)::DOUBLE AS spec,
  (CASE WHEN contains({c}, '?') THEN 20 ELSE 0 END + CASE WHEN contains({c}, '!') THEN 15 ELSE 0 END + CASE WHEN {b.terms("low", q.EMOTIONS)} + {b.matching("low", r"frustrat[\p{L}\p{N}_]+")} > 0 THEN 25 ELSE 0 END
   + CASE WHEN {b.among("raw", ["I"])} + {b.among("low", q.ACTIVE)} > {b.among("low", q.PASSIVE)} THEN 20 ELSE 0 END + CASE WHEN len(raw) > 50 THEN 20 ELSE 0 END) AS points FROM toks),
m AS (SELECT *, {_LENGTH.format(c)} AS length_s,
  CASE WHEN n = 0 THEN 0 WHEN filler < 0.05::DOUBLE AND content > 0.3::DOUBLE THEN 100 WHEN filler < 0.1::DOUBLE AND content > 0.2::DOUBLE THEN 85 WHEN filler < 0.15::DOUBLE THEN 70 WHEN filler < 0.25::DOUBLE THEN 50 ELSE 30 END::DOUBLE AS density_s,
  CASE WHEN n = 0 THEN 0 WHEN spec > 0.1::DOUBLE AND vague < 0.03::DOUBLE THEN 100 WHEN spec > 0.05::DOUBLE AND vague < 0.05::DOUBLE THEN 85 WHEN vague < 0.1::DOUBLE THEN 70 WHEN vague < 0.15::DOUBLE THEN 50 ELSE 30 END::DOUBLE AS specificity_s,
  CASE WHEN n = 0 THEN 0 WHEN points >= 80 THEN 100 WHEN points >= 60 THEN 85 WHEN points >= 40 THEN 70 WHEN points >= 20 THEN 50 ELSE 30 END::DOUBLE AS engagement_s FROM counts),
mm AS (SELECT *, length_s * 0.2::DOUBLE + density_s * 0.3::DOUBLE + specificity_s * 0.3::DOUBLE + engagement_s * 0.2::DOUBLE AS overall FROM m)"""


_D = f"WITH {b.DOCS}, dd AS (SELECT * FROM docs WHERE text IS NOT NULL), "
_M = _D + _counted("dd", "doc_id", "text") + " "
_QSCORE = f"""CASE WHEN s >= 85 THEN 100 WHEN s >= 70 THEN 85 WHEN s >= 55 THEN 70 ELSE 50 END::DOUBLE"""
_MARKS = "(length(instruction) - length(replace(instruction, '?', '')))"
_QPOINTS = f"""50 + CASE WHEN {_MARKS} > 0 OR {b.contains("lower(instruction)", q.QUESTION_WORDS)} THEN 20 ELSE 0 END + CASE WHEN NOT {b.contains("lower(instruction)", q.VAGUE_QUESTIONS)} THEN 15 ELSE 0 END
 + CASE WHEN NOT ({_MARKS} > 1 OR (contains(lower(instruction), ' and ') AND {_MARKS} > 0)) THEN 10 ELSE 0 END + CASE WHEN len({b.words("instruction")}) BETWEEN 5 AND 20 THEN 15 WHEN len({b.words("instruction")}) > 20 THEN -10 ELSE 0 END"""
_STOP = "[" + ", ".join(repr(w) for w in q.STOPWORDS) + "]"
_KEYS = f"list_filter(list_distinct({b.words('lower(instruction)')}), lambda t: NOT list_contains({_STOP}, t))"
_OVERLAP = f"len(list_filter({_KEYS}, lambda t: list_contains({b.words('lower(response)')}, t))) / len({_KEYS})::DOUBLE"
_RELEVANCE = f"""CASE WHEN len({_KEYS}) = 0 THEN 70 ELSE (SELECT CASE WHEN s >= 85 THEN 100 WHEN s >= 70 THEN 85 WHEN s >= 55 THEN 70 ELSE 50 END FROM (SELECT 50 + CASE WHEN {_OVERLAP} > 0.5::DOUBLE THEN 30 WHEN {_OVERLAP} > 0.3::DOUBLE THEN 20 WHEN {_OVERLAP} > 0.1::DOUBLE THEN 10 ELSE 0 END
 + CASE WHEN contains(lower(response), substring(lower(instruction), 1, 30)) OR {b.contains("lower(response)", q.ACKNOWLEDGING)} THEN 20 ELSE 0 END AS s)) END::DOUBLE"""
_P = f"WITH {b.PAIRS}, good AS (SELECT * FROM prs WHERE instruction <> '' AND response <> ''), asked AS (SELECT *, {_QPOINTS} AS s FROM good), rel AS (SELECT *, {_QSCORE} AS question_s, {_RELEVANCE} AS relevance_s FROM asked), " + _counted("rel", "pair_id", "response") + ", scored AS (SELECT *, question_s * 0.2::DOUBLE + overall * 0.5::DOUBLE + relevance_s * 0.3::DOUBLE AS pair_overall FROM mm) "
_REPORT = _P + ", report AS (SELECT (SELECT count(*) FROM prs) AS n_total, count(*) AS n_scored, round(avg(pair_overall), 6) AS avg_score, round(min(pair_overall), 6) AS min_score, round(max(pair_overall), 6) AS max_score, round(avg(length(response)), 6) AS avg_length, round(avg((pair_overall < 60)::INT::DOUBLE) * 100, 6) AS f_pct FROM scored) "
_LOW = "low AS (SELECT " + b.words("lower(text)") + " AS w FROM dd)"


def _grams(n: int, k: int) -> str:
    g = " || ' ' || ".join(f"w[i + {j}]" for j in range(n))
    return _D + _LOW + f", grams AS (SELECT unnest(list_transform(range(1, greatest(len(w) - {n - 2}, 1)), lambda i: {g})) AS ngram FROM low), top AS (SELECT ngram, count(*) AS n FROM grams GROUP BY ngram ORDER BY n DESC, ngram LIMIT {k}) SELECT ngram, n, round(n / sum(n) OVER (), 6) AS share FROM top"


_VOCAB = "vocab AS (SELECT coalesce(sum(n), 0)::BIGINT AS total_words, count(*) AS unique_words, round(count(*) / sum(n), 6) AS ttr, round(sum(length(w) * n) / sum(n), 6) AS avg_word_length FROM (SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM low) GROUP BY w))"
_STYLE = "style AS (SELECT " + ", ".join(
    [r"sum(len(regexp_extract_all(text, '\?')))::BIGINT AS questions", "sum(len(regexp_extract_all(text, '!')))::BIGINT AS exclamations", r"sum(len(regexp_extract_all(text, '[\p{L}\p{N}_]+''[a-z]+')))::BIGINT AS contractions"] + [f"sum({b.terms('low', t)})::BIGINT AS {k}" for k, t in pr.STYLE.items()]
) + f" FROM (SELECT text, {b.words('lower(text)')} AS low FROM dd))"
_TRAITS = "traits AS (SELECT " + ", ".join(f"sum({b.terms('low', t)}{' + len(regexp_extract_all(text, ' + repr(pr.PLAYFUL_SIGNS) + '))' if k == 'playful' else ''})::BIGINT AS {k}" for k, t in pr.TRAITS.items()) + f" FROM (SELECT text, {b.words('lower(text)')} AS low FROM dd))"
_TALL = "tall AS (" + " UNION ALL ".join(f"SELECT {i} AS ord, '{k}' AS trait, {k} AS n FROM traits" for i, k in enumerate(pr.TRAITS)) + ")"
_EVERY = " + ".join(pr.STYLE_ORDER)
_TOTAL = " + ".join(pr.TRAITS)

SQL = {
    "length_score": _M + f"SELECT doc_id, length_s AS score, {_LENGTH_REASON} AS reason FROM mm",
    "density_score": _M + "SELECT doc_id, density_s AS score, CASE density_s WHEN 0 THEN 'Empty' WHEN 100 THEN 'High information density' WHEN 85 THEN 'Good content' WHEN 70 THEN 'Moderate content' WHEN 50 THEN 'Some filler' ELSE 'Too much filler' END AS reason FROM mm",
    "density_score_custom": _D + _counted("dd", "doc_id", "text", fillers=OWN_FILLERS) + " SELECT doc_id, density_s AS score FROM mm",
    "specificity_score": _M + "SELECT doc_id, specificity_s AS score, CASE specificity_s WHEN 0 THEN 'Empty' WHEN 100 THEN 'Highly specific' WHEN 85 THEN 'Good specificity' WHEN 70 THEN 'Moderate specificity' WHEN 50 THEN 'Somewhat vague' ELSE 'Very vague' END AS reason FROM mm",
    "specificity_score_custom": _D + _counted("dd", "doc_id", "text", vague=OWN_VAGUE) + " SELECT doc_id, specificity_s AS score FROM mm",
    "engagement_score": _M + "SELECT doc_id, engagement_s AS score, CASE engagement_s WHEN 0 THEN 'Empty' WHEN 100 THEN 'Highly engaged' WHEN 85 THEN 'Good engagement' WHEN 70 THEN 'Moderate engagement' WHEN 50 THEN 'Limited engagement' ELSE 'Disengaged' END AS reason, points FROM mm",
    "message_quality": _M + "SELECT doc_id, round(overall, 6) AS overall FROM mm",
    "question_score": f"WITH {b.PAIRS}, asked AS (SELECT *, {_QPOINTS} AS s FROM prs) SELECT pair_id, {_QSCORE} AS score FROM asked",
    "relevance_score": f"WITH {b.PAIRS} SELECT pair_id, {_RELEVANCE} AS score FROM prs",
    "pair_quality": _P + "SELECT pair_id, round(pair_overall, 6) AS overall FROM scored",
    "grade_distribution": _P + "SELECT CASE WHEN pair_overall >= 90 THEN 'A' WHEN pair_overall >= 80 THEN 'B' WHEN pair_overall >= 70 THEN 'C' WHEN pair_overall >= 60 THEN 'D' ELSE 'F' END AS grade, count(*) AS n FROM scored GROUP BY 1",
    "dataset_quality_report": _REPORT + "SELECT * FROM report",
    "low_quality_samples": _P + f"SELECT pair_id, round(pair_overall, 6) AS score, substring(instruction, 1, 100) AS instruction, substring(response, 1, 100) AS response, {_LENGTH_REASON.replace('text', 'response')} || '; ' || CASE density_s WHEN 0 THEN 'Empty' WHEN 100 THEN 'High information density' WHEN 85 THEN 'Good content' WHEN 70 THEN 'Moderate content' WHEN 50 THEN 'Some filler' ELSE 'Too much filler' END || '; ' || CASE specificity_s WHEN 0 THEN 'Empty' WHEN 100 THEN 'Highly specific' WHEN 85 THEN 'Good specificity' WHEN 70 THEN 'Moderate specificity' WHEN 50 THEN 'Somewhat vague' ELSE 'Very vague' END AS issues FROM scored WHERE pair_overall < 60 ORDER BY pair_id LIMIT 20",
    "quality_recommendations": _REPORT + ", adv AS (SELECT list_filter([CASE WHEN avg_score < 70 THEN 'score below the recommended threshold' END, CASE WHEN f_pct > 20 THEN printf('%.1f%% of samples have grade F', f_pct) END, CASE WHEN avg_length < 50 THEN 'responses are very short' END, CASE WHEN avg_length > 1000 THEN 'responses are very long' END, CASE WHEN avg_score >= 80 THEN 'excellent: ready for training' END, CASE WHEN avg_score >= 70 AND avg_score < 80 THEN 'good: should train well' END], lambda x: x IS NOT NULL) AS a FROM report) SELECT (unnest(range(0, len(a))))::INT AS n, unnest(a) AS advice FROM adv",
    "trigram_topk": _grams(3, 50),
    "bigram_topk": _grams(2, 50),
    "sentence_starters": _D + rf"s AS (SELECT {b.strip('s')} AS s FROM (SELECT unnest(regexp_split_to_array(text, '[.!?]+')) AS s FROM dd)), st AS (SELECT lower(array_to_string(list_slice(regexp_split_to_array(s, '[\s\p{{Z}}]+'), 1, 3), ' ')) AS starter FROM s WHERE s <> '') SELECT starter, count(*) AS n FROM st GROUP BY starter ORDER BY n DESC, starter LIMIT 30",
    "vocabulary": _D + _LOW + ", " + _VOCAB + " SELECT * FROM vocab",
    "common_words": _D + _LOW + " SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM low) GROUP BY w ORDER BY n DESC, w LIMIT 20",
    "style_markers": _D + _STYLE + " SELECT * FROM style",
    "trait_totals": _D + _TRAITS + " SELECT * FROM traits",
    "traits_top3": _D + _TRAITS + ", " + _TALL + ", ranked AS (SELECT *, row_number() OVER (ORDER BY n DESC, ord) AS r, sum(n) OVER () AS total FROM tall) SELECT r, trait, n FROM ranked WHERE r <= 3 AND n > total * 0.15::DOUBLE",
    "dataset_score": _D + _LOW + ", " + _VOCAB + ", facts AS (SELECT count(*) AS n_samples, round(avg(length(text)), 6) AS avg_length, (SELECT ttr FROM vocab) AS ttr, least((SELECT count(DISTINCT g) FROM (SELECT unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM low)), 50) AS n_patterns FROM dd), sc AS (SELECT *, CASE WHEN n_samples >= 1000 THEN 40 WHEN n_samples >= 500 THEN 30 WHEN n_samples >= 100 THEN 20 ELSE 10 END + CASE WHEN avg_length BETWEEN 50 AND 500 THEN 20 WHEN avg_length >= 30 AND avg_length < 50 THEN 15 WHEN avg_length > 500 THEN 15 ELSE 5 END + CASE WHEN ttr >= 0.5 THEN 20 WHEN ttr >= 0.3 THEN 15 WHEN ttr >= 0.2 THEN 10 ELSE 5 END + CASE WHEN n_patterns >= 200 THEN 20 WHEN n_patterns >= 100 THEN 15 WHEN n_patterns >= 50 THEN 10 ELSE 5 END AS score FROM facts) SELECT *, CASE WHEN score >= 85 THEN 'A - Excellent' WHEN score >= 70 THEN 'B - Good' WHEN score >= 55 THEN 'C - Fair' WHEN score >= 40 THEN 'D - Poor' ELSE 'F - Insufficient' END AS grade, array_to_string(list_filter([CASE WHEN n_samples < 1000 THEN 'size' END, CASE WHEN NOT avg_length BETWEEN 50 AND 500 THEN 'length' END, CASE WHEN ttr < 0.3 THEN 'vocabulary' END, CASE WHEN n_patterns < 100 THEN 'patterns' END], lambda x: x IS NOT NULL), ',') AS warnings FROM sc",
    "pattern_predictions": _D + _LOW + ", " + _VOCAB + ", " + _STYLE + ", " + _TRAITS + f" SELECT array_to_string(list_filter([CASE WHEN questions > ({_EVERY}) * 0.15::DOUBLE THEN 'Questioning' END, CASE WHEN exclamations > ({_EVERY}) * 0.1::DOUBLE THEN 'Energetic' END, CASE WHEN contractions > ({_EVERY}) * 0.1::DOUBLE THEN 'Conversational' END, CASE WHEN technical_terms > casual_terms THEN 'Technical' END, CASE WHEN casual_terms > technical_terms THEN 'Casual' END, CASE WHEN hedging > certainty THEN 'Cautious' END, CASE WHEN certainty > hedging THEN 'Confident' END], lambda x: x IS NOT NULL), ',') AS speaking_style, CASE WHEN avg_word_length > 6 THEN 'Advanced' WHEN avg_word_length > 5 THEN 'Moderate' ELSE 'Simple' END AS vocabulary_level, CASE WHEN formal / greatest({_TOTAL}, 1)::DOUBLE > 0.2::DOUBLE THEN 'Formal' WHEN formal / greatest({_TOTAL}, 1)::DOUBLE > 0.1::DOUBLE THEN 'Semi-formal' ELSE 'Informal' END AS formality FROM style, traits, vocab",
    "avg_response_length": f"WITH {b.PAIRS} SELECT round(avg(length(response)), 6) AS avg_length FROM prs",
}
QUERIES = {k: globals()[k] for k in SQL}
