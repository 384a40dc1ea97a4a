"""Reading level of each document by a latent difficulty model (problem 10).

Each word has a difficulty b and each document a level t on one scale: in a document of level t a word
occurs exp(t * b) times as often as in the whole, up to the document's norm. Documents and words are
fitted in turn, all words from the documents' levels, all documents from their words' difficulties;
reference texts of known level stay where they are and give the scale its ends and the cuts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.language import language, words
from millrace.llm.text_stats import layout, measure
from millrace.plans.runtime import cut, once

#: The levels' places on the scale.
ANCHORS = {"easy": -1.0, "medium": 0.0, "hard": 1.0}
MIN_WORDS = 60
#: Rounds of the fit at least, and at most; it ends when the documents' levels move by less than SETTLED on average.
ROUNDS, MOST_ROUNDS, SETTLED = 2, 10, 0.05
#: Words holding more than 1/HOT of all occurrences are joined by broadcast; there are less than HOT of them.
HOT = 1000
_GRID = np.linspace(-1.6, 1.6, 129)
_DOC = "doc_id long, words array<struct<word:string,n:long>>, total long"


def _word_counts(min_words: int, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
        for b in batches:
            ids, found, total = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if sum(any(c.isalnum() for c in w) for w in t.split()) < min_words:
                    continue
                if check and (language(t) != "en" or layout(measure(t)[1]) is not None):
                    continue
                c = Counter(words(t))
                ids.append(i)
                found.append([{"word": w, "n": n} for w, n in c.items()])
                total.append(sum(c.values()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(found, type=kind), pa.array(total, type=pa.int64())], names=["doc_id", "words", "total"])

    return run


def _difficulty(level_share: np.ndarray, prior: float):
    """Newton's steps for b of each word: the sum of its documents' levels meets what exp(b * t) over all documents gives."""
    mid = _GRID

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
            b = np.zeros(len(s))
            for _ in range(20):
                e = np.exp(np.clip(b[:, None] * mid, -12, 12)) * level_share
                z = e.sum(1)
                m = (e * mid).sum(1) / z
                v = np.maximum((e * mid * mid).sum(1) / z - m * m, 0)
                b = np.clip(b + np.clip((s - n * m - b / prior) / (n * v + 1 / prior), -1, 1), -6, 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(b), batch.column(2)], names=["word", "b", "n"])

    return run


def fit_levels(docs: DataFrame, anchors: DataFrame, rounds: int = ROUNDS, prior: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """(levels, words): doc_id and t of every document and reference; word, b and n of every word.

    docs and anchors: doc_id, words, total; anchors also have t, their fixed level. The first round knows
    the anchors only, the later ones all documents; there are at least `rounds` of them. Each half round is one aggregation by word or by
    document; what comes to the driver is a histogram of levels and one of difficulties. A word in most
    documents is joined by broadcast, see HOT.
    """
    none = F.lit(None).cast("double")
    every = cut(docs.select("doc_id", "words", "total", none.alias("anchor")).unionByName(anchors.select("doc_id", "words", "total", F.col("t").alias("anchor"))), "docs")
    occurrences = cut(every.select("doc_id", F.explode("words").alias("w")).select("doc_id", "w.word", "w.n"), "words")
    levels = every.select("doc_id", "total", F.col("anchor").alias("t"), F.col("anchor"))
    lo, step = float(_GRID[0]), float(_GRID[1] - _GRID[0])
    vocabulary = levels
    done, moved = 0, 1.0
    while done < rounds or (moved > SETTLED and done < MOST_ROUNDS):
        used = levels.where("t is not null")
        place = F.greatest(F.lit(0), F.least(F.lit(len(_GRID) - 1), F.round((F.col("t") - lo) / step))).cast("int")
        share = np.zeros(len(_GRID))
        for r in used.groupBy(place.alias("at")).agg(F.sum("total").alias("n")).collect():
            share[r["at"]] = r["n"]
        if not share.sum():
            share[:] = 1.0
        share = share / share.sum()
        with_t = every.select("doc_id", "words").join(used.select("doc_id", "t"), "doc_id")
        sums = with_t.select("t", F.explode("words").alias("w")).groupBy(F.col("w.word").alias("word")).agg(F.sum(F.col("w.n") * F.col("t")).alias("s"), F.sum("w.n").cast("double").alias("n"))
        vocabulary = cut(sums.mapInArrow(_difficulty(share, prior), "word string, b double, n double"), "difficulty")

        whole = vocabulary.agg(F.sum("n")).first()[0] or 1.0
        weight, times = np.zeros(241), np.linspace(-6, 6, 241)
        for r in vocabulary.groupBy(F.round((F.col("b") + 6) / 0.05).cast("int").alias("at")).agg(F.sum("n").alias("n")).collect():
            weight[r["at"]] = r["n"] / whole
        e = np.exp(np.clip(np.outer(_GRID, times), -12, 12)) * weight
        mean = (e * times).sum(1) / np.maximum(e.sum(1), 1e-300)
        hot = F.broadcast(vocabulary.where(F.col("n") > whole / HOT).select("word", "b"))  # less than HOT rows
        rest = vocabulary.where(F.col("n") <= whole / HOT).select("word", "b")
        scored = occurrences.join(hot, "word").select("doc_id", "n", "b").union(occurrences.join(hot.select("word"), "word", "left_anti").join(rest, "word").select("doc_id", "n", "b"))
        sums = scored.groupBy("doc_id").agg((F.sum(F.col("n") * F.col("b"))).alias("s"))
        before = levels.select("doc_id", F.col("t").alias("before"))
        found = every.select("doc_id", "total", "anchor").join(sums, "doc_id", "left").mapInArrow(_read_off(mean), "doc_id long, total long, anchor double, free double")
        levels = cut(found.select("doc_id", "total", F.coalesce("anchor", F.greatest(F.lit(-1.2), F.least(F.lit(1.2), F.col("free")))).alias("t"), "anchor", "free").join(before, "doc_id", "left"), "levels")
        moved = levels.where("anchor is null").agg(F.avg(F.abs(F.col("t") - F.coalesce("before", F.lit(0.0))))).first()[0] or 0.0
        levels = levels.drop("before")
        done += 1
    return levels, vocabulary


def _read_off(mean: np.ndarray):
    """The level whose expected mean difficulty is that of the document."""
    mean = np.maximum.accumulate(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            s = np.nan_to_num(b.column(3).to_numpy(zero_copy_only=False).astype(float)) / np.maximum(total, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.interp(s, mean, _GRID))], names=["doc_id", "total", "anchor", "free"])

    return run


def reading_levels(documents: DataFrame, reference: DataFrame, rounds: int = ROUNDS, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, difficulty, level_name) of each distinct English prose document of at least min_words words.

    The cuts lie midway between the nearest references of neighbouring levels, as the fitted model places
    them by their words alone. Other languages, lists, tables, junk, short, empty and null texts are left
    out. Line layout, headings, speakers' names and mark-up don't matter: only whole words count.
    reference: ref_id, level_name, text (bounded: a few texts a level); without one there are no levels.
    """
    texts = once(documents.select("doc_id", "text").where(F.length("text") >= 2 * min_words - 1), "doc_id")
    docs = texts.where("doc_id is not null").mapInArrow(_word_counts(min_words, True), _DOC)
    place = F.create_map(*[x for k, v in ANCHORS.items() for x in (F.lit(k), F.lit(v))])[F.col("level_name")]
    refs = reference.where(F.col("text").isNotNull()).select((-F.col("ref_id") - F.lit(1 << 40)).alias("doc_id"), "text", place.alias("t")).where("t is not null").dropDuplicates(["doc_id"])
    counted = refs.select("doc_id", "text").mapInArrow(_word_counts(1, False), _DOC).join(refs.select("doc_id", "t"), "doc_id")
    levels, _ = fit_levels(docs, counted, rounds)
    ends = {r["anchor"]: r for r in levels.where("anchor is not null").groupBy("anchor").agg(F.min("free").alias("lo"), F.max("free").alias("hi")).collect()}

    def between(low: str, high: str) -> float:
        a, b = ends.get(ANCHORS[low]), ends.get(ANCHORS[high])
        return (a.hi + b.lo) / 2 if a and b else (ANCHORS[low] + ANCHORS[high]) / 4

    level = F.when(F.col("free") < between("easy", "medium"), "easy").when(F.col("free") > between("medium", "hard"), "hard").otherwise("medium")
    return levels.where("anchor is null").select("doc_id", F.round("free", 6).alias("difficulty"), level.alias("level_name"))
