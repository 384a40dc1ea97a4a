"""Column functions on text. All regular expressions are literals, so that each is compiled once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a word is a run of letters, digits and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"
BLANK = r"[\s\p{Z}]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without blanks of any kind at both ends; null stays null."""
    return F.regexp_replace(col(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def words(c) -> Column:
    """The words as written; an empty list for empty texts, null for null."""
    return F.regexp_extract_all(col(c), F.lit(f"({WORD})"), F.lit(1))


def lower_words(c) -> Column:
    return words(F.lower(col(c)))


def padded(c) -> Column:
    """The words between single blanks, with one at either end: a form in which words and phrases are counted by one pattern."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(col(c), r"[^\p{L}\p{N}_]+", " ")), F.lit(" "))


def count_all(pad: Column) -> Column:
    """How many words a padded text has."""
    return F.regexp_count(pad, F.lit("[^ ]+"))


def count_matching(pad: Column, pattern: str) -> Column:
    """How many words, or runs of words, of a padded text match the pattern as a whole, overlapping ones too."""
    return F.regexp_count(pad, F.lit(f"(?= (?:{pattern}) )"))


def count_terms(pad: Column, terms: list[str]) -> Column:
    """How often words and phrases of the list occur in a padded text; a place counts once for each term it matches."""
    single = [t for t in terms if " " not in t]
    total = count_matching(pad, "|".join(single)) if single else F.lit(0)
    for p in terms:
        if " " in p:
            total = total + count_matching(pad, p)
    return total


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n words, joined by blanks; none where there are fewer words.

    tokens should be a column of its own, not an expression: the function reads it at every place.
    """
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - F.lit(n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def any_contains(c, terms: list[str]) -> Column:
    """Whether any term is part of the text, also within words."""
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains(col(c), F.lit(t))
    return hit


def first_category(c, categories: dict[str, list[str]]) -> Column:
    """The first category of which any term is part of the text, else null."""
    out = F.lit(None).cast("string")
    for name, terms in reversed(categories.items()):
        out = F.when(any_contains(c, terms), name).otherwise(out)
    return out
