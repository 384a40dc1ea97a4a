"""Frequency of every distinct term of a collection (problem 1).

Pairs of term and record are sorted by range partitions over both, so that a term that occurs in
every record spreads over many tasks; one scan over the runs counts occurrences and records.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.runtime import spread, width

#: Terms in fewer records are rare, in a greater share of the records common.
RARE_BELOW, COMMON_ABOVE = 3, 0.25
ERROR_PREFIX = "[ERROR"
_RUN = regex.compile(r"[\p{L}\p{Nd}]+")


def terms(text: str) -> list[str]:
    """The terms of a text: runs of letters and digits of its composed form, in lower case and composed."""
    found = _RUN.findall(unicodedata.normalize("NFC", text))
    return found if text.isascii() and text.islower() else [unicodedata.normalize("NFC", t.lower()) for t in found]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        term, at, n = [], [], []
        for i, text in enumerate(b.column(1).to_pylist()):
            for t, k in Counter(terms(text)).items():
                term.append(t)
                at.append(i)
                n.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(term, type=pa.string()), b.column(0).take(pa.array(at, type=pa.int64())), pa.array(n, type=pa.int64())], names=["term", "rec", "n"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the runs of sorted (term, rec, n); the last run is held back until the next batch."""
    held, last_rec = None, None

    def emit(t, o, r):
        return pa.RecordBatch.from_arrays([pa.array(t, type=pa.string()), pa.array(o, type=pa.int64()), pa.array(r, type=pa.int64())], names=["term", "n_occurrences", "n_records"])

    for b in batches:
        size = b.num_rows
        if not size:
            continue
        term, rec, n = b.column(0), b.column(1), b.column(2).to_numpy(zero_copy_only=False)
        new = np.ones(size, dtype=bool)
        fresh = np.ones(size, dtype=bool)
        if size > 1:
            new[1:] = pc.not_equal(term.slice(1), term.slice(0, size - 1)).to_numpy(zero_copy_only=False)
            same = pc.equal(rec.slice(1), rec.slice(0, size - 1))
            both_null = pc.and_(pc.is_null(rec.slice(1)), pc.is_null(rec.slice(0, size - 1)))
            fresh[1:] = new[1:] | ~pc.or_(pc.fill_null(same, False), both_null).to_numpy(zero_copy_only=False)
        if held and held[0] == term[0].as_py() and last_rec == rec[0].as_py():
            fresh[0] = False  # the row before, in the last batch, is the same pair
        starts = np.flatnonzero(new)
        occ = np.add.reduceat(np.where(fresh, n, 0), starts)
        recs = np.add.reduceat(fresh.astype("int64"), starts)
        names = term.take(pa.array(starts)).to_pylist()
        if held and held[0] == names[0]:
            occ[0] += held[1]
            recs[0] += held[2]
        elif held:
            yield emit([held[0]], [held[1]], [held[2]])
        held, last_rec = (names[-1], int(occ[-1]), int(recs[-1])), rec[size - 1].as_py()
        if len(names) > 1:
            yield emit(names[:-1], occ[:-1], recs[:-1])
    if held:
        yield emit([held[0]], [held[1]], [held[2]])


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(term, n_occurrences, n_records) of every distinct term.

    A record is a distinct key; rows delivered again are met side by side in the scan and count once.
    Null texts have no terms, a null key is one record. No cap on terms or records: the pairs of one
    term may span partitions, whose partial counts (one row a term and partition) are added up.
    """
    pairs = T.StructType([T.StructField("term", T.StringType()), T.StructField("rec", df.schema[key].dataType), T.StructField("n", T.LongType())])
    counts = T.StructType([T.StructField("term", T.StringType()), T.StructField("n_occurrences", T.LongType()), T.StructField("n_records", T.LongType())])
    rows = df.select(F.col(key), F.col(text)).where(F.col(text).isNotNull()).mapInArrow(_pairs, pairs)
    placed = rows.repartitionByRange(width(df.sparkSession), "term", "rec").sortWithinPartitions("term", "rec")
    partial = placed.mapInArrow(_scan, counts)
    return partial.groupBy("term").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))


def marked_terms(df: DataFrame, key: str, text: str, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """term_counts with n_all, the number of records, and mark: rare, common or null. Rare goes before common."""
    total = df.where(F.col(text).isNotNull()).agg(F.countDistinct(F.struct(F.col(key))).alias("n_all"))
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") > F.lit(common_above) * F.col("n_all"), "common")
    return term_counts(df, key, text).crossJoin(F.broadcast(total)).withColumn("mark", mark)  # one row


def answers(probe: DataFrame) -> DataFrame:
    """The records of the collection: answers that are no error marker."""
    return spread(probe.select("answer_id", "response")).where(F.col("response").isNotNull() & ~F.startswith("response", F.lit(ERROR_PREFIX)))
