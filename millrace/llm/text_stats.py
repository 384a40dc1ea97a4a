"""Text quality statistics and what they tell about a text's shape (problem 5).

Each text gets a vector of statistics. The mean and covariance of ordinary prose are fitted for each
language over all texts, robustly and without any notion of what prose is: from medians, then twice from
the texts nearest to the last fit. The Mahalanobis distance from them marks outliers, each statistic's
part of it says why, and the statistic that tells of a shape with the greatest part names it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.language import function_words, language, words
from millrace.plans.runtime import cut, once

#: The statistics, all of them between 0 and about 1, and the least spread that prose has in each: a few items, a long
#: number or an odd line don't make a text another kind.
STATS = (
    "word_count", "mean_word_length", "symbol_ratio", "digit_ratio", "end_punctuation", "common_words", "long_token", "repetition",
    "items", "entries", "field_rows", "tags", "odd_words", "upper_ratio",
)
LEAST_SPREAD = (0.25, 0.15, 0.05, 0.05, 0.35, 0.15, 0.06, 0.07, 0.12, 0.12, 0.12, 0.12, 0.06, 0.12)
#: The statistics that tell of each shape.
TELLING = {"table": ("field_rows",), "list": ("items", "entries", "tags"), "junk": ("symbol_ratio", "long_token", "repetition", "odd_words")}
#: Texts under this many characters have statistics but no shape.
MIN_CHARS = 40
#: Squared distance above which a text is an outlier: the 0.975 quantile of chi-square with 14 degrees of freedom. A shape's own statistic makes up at least this share of it.
FAR, OWN = 26.1, 0.7
_ITEM = regex.compile(r"(?:[-*+•·▪◦‣–—→>✓✔☐☑]|\[[ xX✓]?\]|\(?\d{1,3}[.):]|\(?[a-zA-Z][.)]|\(?[ivx]{1,4}[.)]|#\d+)\s+\S")
_CODE = regex.compile(r"```.*?(?:```|\Z)", regex.S)
_WORDISH = regex.compile(r"[\p{L}\p{M}\p{N}]")
_VOWEL = regex.compile(r"[aeiouyæøœ]")
_SPACED = regex.compile(r"\S(?: {2,}|\t+)\S")
_MARK = regex.compile(r"[\p{S}\p{P}]")
#: Words with which a line is a clause, not an entry of a list.
CLAUSE_WORDS = frozenset("i we he she it you they was were is are am has have had did do does can could will would my who".split())
_NO_SPACE = frozenset(("ja", "zh", "th", "ko"))
_RULE = regex.compile(r"[|:\-=+ ]+")


def _fields(lines: list[str]) -> tuple[float, str]:
    """The share of lines that are rows of fields of the likeliest delimiter, and the delimiter."""
    best = (0.0, "")
    for d in "|;\t,":
        counts = [line.strip("|").count(d) for line in lines if not (d == "|" and _RULE.fullmatch(line))]
        if not counts:
            continue
        usual = Counter(counts).most_common(1)[0][0]
        if usual >= (1 if d in "|\t" else 2):
            share = sum(abs(c - usual) <= (d != ",") for c in counts) / len(counts)
            cells = [c for line in lines for c in line.split(d)]
            if d in "|\t" or sum(len(c.split()) for c in cells) <= 2.5 * len(cells):
                best = max(best, (share, d))
    counts = [len(_SPACED.findall(line)) for line in lines]
    usual = Counter(counts).most_common(1)[0][0] if counts else 0
    if usual >= 2:
        best = max(best, (sum(c >= usual - 1 and c > 0 for c in counts) / len(counts), " "))
    return best


def _tags(body: str) -> tuple[float, float]:
    """How much the text is a row of short entries between separators: share of entries that are short, entries a word."""
    if len(regex.findall(r"[.!?](?:\s|$)", body.rstrip(" .,;\n"))) > 0:
        return 0.0, 0.0
    best = (0.0, 0.0)
    for sep in (r",", r";", r"\|", r"/", r"·|•", r"\s+(?=#)"):
        entries = [e.strip() for e in regex.split(sep, body.strip().strip(".,;|·•/")) if e.strip()]
        if len(entries) >= 6:
            short = sum(len(e.split()) <= 5 for e in entries) / len(entries)
            n = sum(len(e.split()) for e in entries)
            if n <= 2.8 * len(entries):
                best = max(best, (short, len(entries) / max(1, n)))
    return best


_ASCII = bytes(range(128))
_NOT_WORDISH = bytes(i for i in _ASCII if not chr(i).isalnum())
_NOT_DIGIT = bytes(i for i in _ASCII if not chr(i).isdigit())
_NOT_UPPER = bytes(i for i in _ASCII if not chr(i).isupper())
_NOT_VOWEL = bytes(i for i in range(256) if chr(i) not in "aeiouy ")
_MARKS_ONLY = {i: None for i in _ASCII if not chr(i).isalnum()}
_END_MARKS = frozenset(".!?…。！？\"')”")
_MID_MARKS = frozenset(".!?:…。！？,")


def _counts(text: str) -> tuple[int, int, int]:
    """How many letters and digits, digits, and capitals a text has."""
    if text.isascii():
        raw = text.encode()
        return len(raw.translate(None, _NOT_WORDISH)), len(raw.translate(None, _NOT_DIGIT)), len(raw.translate(None, _NOT_UPPER))
    return len(_WORDISH.findall(text)), sum(map(str.isdigit, text)), sum(map(str.isupper, text))


def measure(text: str) -> tuple[str, dict[str, float]]:
    """The language, and counts and shares of the text's words, marks and lines."""
    lines = [s for line in text.split("\n") if (s := line.strip())]
    tokens = text.split()
    n_lines, n_tokens, solid = len(lines), len(tokens), sum(map(len, tokens))
    w = words(text)
    lang = language(text, w)
    known = function_words(lang)
    wordish, digits, capitals = _counts(text)
    items, short, prose, rows, delimiter, clauses = 0, 0, 0, 0.0, "", 0
    in_items = in_prose = longest_line = 0
    if n_lines >= 2:
        rows, delimiter = _fields(lines)
        for line in lines:
            own = line.split()
            longest_line = max(longest_line, len(own))
            item = _ITEM.match(line) is not None
            items += item
            in_items += item * len(line)
            short += len(own) <= 7 and line[-1] not in _MID_MARKS
            own_words = words(line)
            clauses += not CLAUSE_WORDS.isdisjoint(own_words)
            if len(own_words) >= 9 and not item:
                in_prose += len(line)
    elif lines:
        longest_line = n_tokens
        if _ITEM.match(lines[0]):
            items, in_items = 1, len(lines[0])
        elif len(w) >= 9:
            in_prose = len(lines[0])
    size = sum(map(len, lines)) or 1
    tag, density = _tags(text) if n_lines <= 2 and max(map(text.count, ",;|/·•#"), default=0) >= 4 else (0.0, 0.0)
    top = next((n for t, n in Counter(map(str.lower, tokens)).most_common() if not t.isascii() or t.translate(_MARKS_ONLY)), 0) / n_tokens if n_tokens >= 6 else 0.0
    chars = set(text)
    top_char = max(map(text.count, chars)) / len(text) if len(text) >= 20 and len(chars) <= 12 else 0.0
    longest = max(map(len, tokens), default=0)
    latin = [x for x in w if len(x) >= 3 and x.isascii()]
    kept = " ".join(latin).encode().translate(None, _NOT_VOWEL).split(b" ")
    odd = kept.count(b"") / len(latin) if latin else 0.0
    vowels = sum(map(len, kept)) / max(1, sum(map(len, latin)))
    if rows and delimiter.strip():  # what separates fields is no symbol of a row, nor is a rule below the head
        own = solid - rows * (text.count(delimiter) + sum(len(line) for line in lines if _RULE.fullmatch(line)))
        solid_own = max(wordish, own)
    else:
        solid_own = solid
    ends = sum(line[-1] in _END_MARKS for line in lines) / n_lines if lines else 0.0
    spaced = lang not in _NO_SPACE
    return lang, {
        "word_count": min(1.0, math.log1p(len(w)) / 7), "mean_word_length": min(2.0, (sum(map(len, w)) / len(w)) / 10) if w and spaced else 0.45, "symbol_ratio": 1 - wordish / solid_own if solid_own else 1.0, "digit_ratio": digits / solid if solid else 0.0,
        "end_punctuation": ends, "common_words": sum(map(known.__contains__, w)) / len(w) if known and w else (0.45 if lang and not known else 0.0), "longest_token": longest if spaced else 9, "repetition": max(top, top_char if top_char > 0.3 else 0.0),
        "item_lines": items / n_lines if lines else 0.0, "short_lines": short / n_lines if n_lines >= 3 else 0.0, "field_rows": rows, "separators": tag, "odd_words": odd, "upper_ratio": capitals / max(1, wordish),
        "lines": n_lines, "prose": in_prose / size, "items": in_items / size, "vowels": vowels, "latin": len(latin), "density": density, "clauses": clauses / max(1, n_lines) if lang in ("en", "") else 0.0, "longest_line": longest_line,
        "delimited": rows > 0 and delimiter.strip() != "", "long_share": longest / max(1, solid) if spaced else 0.0,
    }


def _unit(x: float) -> float:
    return max(0.0, min(1.0, x))


def vector(m: dict[str, float]) -> list[float]:
    """The statistics in the order of STATS from what `measure` found.

    Those of items, entries and rows are shares of the text as a whole: what is prose beside them takes from them.
    """
    apart = 1 - m["prose"]
    several = _unit((m["lines"] - 1) / 2)
    return [
        m["word_count"], m["mean_word_length"], m["symbol_ratio"], m["digit_ratio"], m["end_punctuation"], m["common_words"], _unit((m["longest_token"] - 30) / 30) * m["long_share"], m["repetition"],
        math.sqrt(m["item_lines"] * m["items"]) * apart * several, m["short_lines"] * apart * several * _unit((13 - m["longest_line"]) / 4) * (1 - m["clauses"]) * _unit((0.9 - m["common_words"]) / 0.3),
        m["field_rows"] * apart * (m["lines"] >= 3 or m["delimited"]), m["separators"] * _unit(m["density"] / 0.3), _unit(m["latin"] / 5) * max(m["odd_words"], _unit((0.36 - m["vowels"]) / 0.3)) * _unit(1 - 5 * m["common_words"]), m["upper_ratio"],
    ]


#: The shapes' statistics by their places, and by shape in the order in which a tie goes.
_SHAPES = tuple(TELLING)
_PLACES = [[STATS.index(n) for n in TELLING[k]] for k in _SHAPES]


def layout(m: dict[str, float]) -> str | None:
    """The shape of a single text without a fit: by its statistics in units of the least spread, from a prose that has none of them."""
    v = vector(m)
    parts = [max(max(0.0, v[i] - 0.05) ** 2 / LEAST_SPREAD[i] ** 2 for i in places) for places in _PLACES]
    best = max(range(len(parts)), key=lambda k: (parts[k], -k))
    return _SHAPES[best] if parts[best] >= FAR else None


_ROW = T.StructType([T.StructField("lang", T.StringType()), T.StructField("stats", T.ArrayType(T.DoubleType())), T.StructField("long_enough", T.BooleanType())])


def _lists(x: np.ndarray) -> pa.Array:
    """A matrix as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)), pa.array(np.ascontiguousarray(x).ravel()))


def _measured(keys: list[T.StructField], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, rows, enough = [], [], []
            for t in b.column(b.schema.get_field_index(text)).to_pylist():
                lang, m = measure(t)
                langs.append(lang)
                rows.append(vector(m))
                enough.append(len(t) >= MIN_CHARS)
            cols = [pa.array(langs, type=pa.string()), _lists(np.array(rows, dtype=np.float64).reshape(len(rows), len(STATS))), pa.array(enough, type=pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in keys), *cols], names=[*(f.name for f in keys), "lang", "stats", "long_enough"])

    return run


def text_statistics(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, lang, stats (in the order of STATS) and long_enough, whether the text is long enough for a shape. Null and blank texts are left out."""
    rows = df.select(*keys, text).where(F.col(text).rlike(r"(?U)\S"))
    fields = [rows.schema[k] for k in keys]
    return rows.mapInArrow(_measured(fields, text), T.StructType([*fields, *_ROW.fields]))


def fit_prose(measured: DataFrame, min_rows: int = 200, rounds: int = 2) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and inverse covariance of prose for each language with min_rows texts, and '' for all others.

    Every text counts in the medians; each round takes the texts within three times the expected squared distance
    of the last one. Sums over all rows by language; a few hundred numbers a language come to the driver, and there
    are at most as many languages as `language` knows.
    """
    k = len(STATS)
    x = [F.col("stats")[i] for i in range(k)]
    group = F.col("group")
    least = np.array(LEAST_SPREAD)
    grouped = measured.withColumn("group", F.explode(F.array_distinct(F.array("lang", F.lit("")))))
    centre = {}
    for r in grouped.groupBy(group).agg(F.count("*").alias("n"), *[F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, c in enumerate(x)]).collect():
        if r.n >= min_rows or r["group"] == "":
            q = np.array([r[f"q{i}"] for i in range(k)], dtype=float)
            spread = np.maximum((q[:, 2] - q[:, 0]) / 1.35, least)
            centre[r["group"]] = (q[:, 1], np.diag(1 / spread**2))
    for _ in range(rounds):
        sums = measured.select("lang", "stats").mapInArrow(_moments(centre, 3.0 * k), "group string, n long, sums array<double>")
        tall = sums.select("group", "n", F.posexplode("sums").alias("at", "x")).groupBy("group", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        found: dict[str, tuple[int, np.ndarray]] = {}
        for r in tall.collect():
            found.setdefault(r["group"], (r.n, np.zeros(k + k * k)))[1][r["at"]] = r.x
        for g, (n, x) in found.items():
            if g in centre and n >= min(min_rows, 30):
                mean = x[:k] / n
                cov = x[k:].reshape(k, k) / n - np.outer(mean, mean)
                centre[g] = (mean, np.linalg.inv(cov + np.diag(least**2)))
    return centre


def _distances(b: pa.RecordBatch, centre: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The statistics of a batch, each one's part of the squared distance from its language's prose, and the group taken for it."""
    x = np.asarray(b.column(b.schema.get_field_index("stats")).flatten(), dtype=float).reshape(b.num_rows, -1)
    codes = b.column(b.schema.get_field_index("lang")).dictionary_encode()
    names = [g if g in centre else "" for g in codes.dictionary.to_pylist()]
    langs = np.array(names, dtype=object)[codes.indices.to_numpy(zero_copy_only=False)]
    parts = np.zeros_like(x)
    for g in set(names):
        at = langs == g
        z = x[at] - centre[g][0]
        parts[at] = z * (z @ centre[g][1])
    return x, parts, langs


def _moments(centre: dict, most: float):
    """Number, sums and sums of products of the near texts by group, and of all groups together: a row each for a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, parts, langs = _distances(b, centre)
            near = parts.sum(1) <= most
            for g in {*langs, ""}:
                y = x[near] if g == "" else x[near & (langs == g)]
                t = total.setdefault(g, [0, np.zeros(x.shape[1] * (x.shape[1] + 1))])
                t[0] += len(y)
                t[1] += np.concatenate([y.sum(0), (y.T @ y).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.string()), pa.array([t[0] for t in total.values()], type=pa.int64()), pa.array([t[1] for t in total.values()], type=pa.list_(pa.float64()))], names=["group", "n", "sums"])

    return run


def with_distance(measured: DataFrame, centre: dict[str, tuple[np.ndarray, np.ndarray]], far: float = FAR) -> DataFrame:
    """measured, with d2, the squared Mahalanobis distance from its language's prose, parts, each statistic's part of it, and shape.

    An outlier is of the shape whose telling statistic has the greatest part, if that alone makes up OWN of the limit.
    """
    kept = [f for f in measured.schema.fields if f.name != "long_enough"]
    schema = T.StructType([*kept, T.StructField("d2", T.DoubleType()), T.StructField("parts", T.ArrayType(T.DoubleType())), T.StructField("shape", T.StringType())])
    names = pa.array(_SHAPES, type=pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, parts, _ = _distances(b, centre)
                d2 = parts.sum(1)
                own = np.stack([parts[:, places].max(1) for places in _PLACES], 1)
                enough = b.column(b.schema.get_field_index("long_enough")).to_numpy(zero_copy_only=False)
                is_one = enough & (d2 > far) & (own.max(1) >= OWN * far)
                shape = names.take(pa.array(own.argmax(1), mask=~is_one))
                cols = [b.column(b.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(d2), _lists(parts), shape], names=[f.name for f in schema.fields])

    return measured.mapInArrow(run, schema)


def text_quality(df: DataFrame, keys: list[str], text: str, far: float = FAR) -> DataFrame:
    """keys, lang, stats, d2, parts and `shape` of all texts: list, table or junk where the text is an outlier of that kind.

    df: one row a text, keys unique. Null and blank texts are left out, texts under 40 characters have no
    shape. Every text counts in the fit. An empty table gives an empty one.
    """
    measured = cut(text_statistics(df, keys, text), "stats")
    centre = fit_prose(measured)
    if not centre:
        centre = {"": (np.zeros(len(STATS)), np.diag(1 / np.array(LEAST_SPREAD) ** 2))}
    return with_distance(measured, centre, far)


def record_texts(pairs: DataFrame, conversation: DataFrame) -> DataFrame:
    """(src, rec_id, text) of the distinct responses and turns."""
    a = pairs.select(F.lit("pairs").alias("src"), F.col("pair_id").alias("rec_id"), F.col("response").alias("text"))
    b = conversation.select(F.lit("conversation").alias("src"), F.col("msg_id").alias("rec_id"), F.col("content").alias("text"))
    return once(a.union(b).where("text is not null"), "src", "rec_id")
