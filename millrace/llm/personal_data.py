"""Personal information in free text, found by bootstrapped contextual extraction (problem 4).

A grammar of surface forms proposes candidates with the words around them. Seed entities (known names,
international numbers, labelled documents, street types) rate the patterns of words they stand in; rated
patterns rate the other candidates in them, and so on for a few rounds over the graph of patterns and
instances. Candidates in high-confidence patterns, and runs of name words learned that way, are found.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.runtime import cut, once, width

KINDS = ("email", "phone", "id_number", "address", "name")
ROUNDS = 3
#: A name has at most so many words, particles and initials not counted; every run of so many within a longer one is a candidate.
NAME_WORDS = 4
#: A label stands at most so many tokens before its number, in the same sentence.
LABEL_TOKENS = 14
#: A pattern counts from so many rated instances on; the least share of them with which it rates words, and with which it tells by itself.
LEAST, SHARE, SURE = 3, 0.25, 0.5
#: The least share of a word's occurrences in rated patterns with which it is a name's word, and below which no pattern makes it one.
WORD, DOUBT = 0.3, 0.1
#: So many occurrences at the start of sentences count as evidence for a name, five times as many against it; the share of a name's occurrences that at least stand elsewhere.
FIRSTS, ELSEWHERE = 2, 0.2
#: Words that label an identity number, street and unit words, titles, particles.
ID_LABELS = r"ssn|social security|tax(?:payer)? (?:id|number|no)|tin|national insurance|nino|passport|identity (?:card|number|document)|id (?:card|number|document|no)|driver'?s? licen[cs]e|driving licen[cs]e|licen[cs]e (?:number|no)|national id|steuer\w*|ausweis\w*|personalausweis\w*|reisepass\w*|führerschein\w*|sozialversicherung\w*|dni|nif|nie|pasaporte|carné|passeport|carte d'identité|sécurité sociale|permis|codice fiscale|carta d'identità|passaporto|patente"
STREETS = "Street St Road Rd Avenue Ave Lane Ln Drive Dr Close Court Ct Place Pl Square Sq Terrace Way Row Mews Crescent Gardens Garden Grove Hill Park Walk Boulevard Blvd Quay Parade Alley Highway Green Yard Wharf Rise View Circle Bend Gate Bridge".split()
ROMANCE_STREETS = "rue avenue place boulevard allée chemin impasse quai cours route passage square via viale piazza corso largo vicolo strada calle avenida plaza paseo camino ronda rua praça".split()
GERMAN_STREETS = "straße strasse str. allee weg gasse platz ring damm ufer hof markt steig stieg graben wall chaussee".split()
UNITS = "Flat Apt Apartment Unit Suite Floor Room Appartement Wohnung Piso".split()
TITLES = frozenset("dr mr mrs ms miss prof professor photographer model author subject client contact name sir dame herr frau m mme mlle sr sra srta don doña sig signor signora dott rev".split())
PARTICLES = "de da di du del della van von der den ten la le al bin ibn".split()

_CAP = r"\p{Lu}[\p{Ll}\p{M}]+(?:[-'’]\p{Lu}?[\p{Ll}\p{M}]+)*"
_CAPS = r"\p{Lu}{2,}(?:[-'’]\p{Lu}+)*"
_TOWN_FIRST = "St\\.?|Saint|Sankt|San|Santa|Port|Little|Great|New|Old|Upper|Lower|North|South|East|West|Bad|Mount|Fort|Lake|Los|Las|Le|La|Kings|Market|Monte|Villa|Neu|Alt"
_TOWN = rf"(?:{_CAP}(?:[ ]{_CAP}){{1,2}}(?=[,.;:)!?\n]|$)|(?:(?:{_TOWN_FIRST})[ ])?{_CAP}(?:-(?:(?:sur|sous|on|upon|le|la|les|am|an-der|del|de)-)?{_CAP})*)"
_CODE = r"(?:\p{Lu}{1,2}\d{1,2}\p{Lu}?\s\d\p{Lu}{2}|\d{5}(?:-\d{4})?|\d{4}\s?[A-Z]{2})"
_UNIT = rf"(?:{'|'.join(UNITS)})\.?\s(?:No\.?\s)?\d+\p{{L}}?"
_TAIL = rf"(?:,\s(?:{_UNIT}|{_CODE}(?:\s{_TOWN})?|{_TOWN}(?:,?\s{_CODE})?)(?![\p{{Ll}}]))*"
_STREET_NAME = rf"(?:(?:St|Mt|Old|New|Upper|Lower)\.?\s)?{_CAP}(?:\s{_CAP}){{0,3}}?"
_ADDRESS = regex.compile(
    rf"(?<![\w@/.-])(?:"
    rf"(?:{_UNIT},\s)?\d{{1,5}}\p{{L}}?\s{_STREET_NAME}\s(?:{'|'.join(STREETS)})\b(?:\.(?=,))?(?=[\s,;.:)!?]|$){_TAIL}"
    rf"|\d{{1,5}}(?:\s?(?:bis|ter))?,?\s(?:{'|'.join(ROMANCE_STREETS)})\s(?:(?:de|du|des|la|le|les|aux|au|del|della|dei|dos|da|d'|l')\s?)*{_CAP}(?:[- ](?:(?:de|du|des|la|le|les|aux|et)\s)?{_CAP}){{0,3}}{_TAIL}"
    rf"|(?:{'|'.join(w.capitalize() for w in ROMANCE_STREETS if w not in ('place', 'avenue', 'square', 'passage', 'route'))})\s(?:(?:de|du|des|la|le|les|del|della|dei)\s)*{_CAP}(?:\s{_CAP}){{0,2}},?\s\d{{1,5}}{_TAIL}"
    rf"|(?:{_CAP}[\s-])?\p{{Lu}}[\p{{Ll}}-]*(?i:{'|'.join(regex.escape(w) for w in GERMAN_STREETS)})\s\d{{1,4}}\s?[a-z]?(?![\p{{L}}\d]){_TAIL}"
    rf"|(?:(?:Am|An der|Im|In der|Zum|Zur|Auf der|Auf dem|Unter den|Hinter der)\s)?{_CAP}(?:\s{_CAP}){{0,2}}\s\d{{1,4}}(?=,\s\d{{5}}\s\p{{Lu}}){_TAIL}"
    rf"|(?:P\.?\s?O\.?\sBox|Postfach|Apartado|BP)\s\d+{_TAIL}"
    rf")"
)
#: A house number before capitalised words without a street word: an address only in an address's pattern.
_LOOSE_ADDRESS = regex.compile(rf"(?<![\w@/.-])(?:(?:{_UNIT},\s)?\d{{1,5}}\p{{L}}?\s(?:The\s)?{_CAP}(?:\s{_CAP}){{0,3}}|{_CAP}(?:\s{_CAP}){{0,2}}\s\d{{1,4}}(?=,\s\d{{5}}\s)){_TAIL}")
_EMAIL = regex.compile(
    r"(?<![\w.+@-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*(?:\s?@\s?|\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\sat\s(?=[\p{L}\p{N}-]+(?:\sdot\s[\p{L}\p{N}-]+)+))"
    r"[\p{L}\p{N}][\p{L}\p{N}-]*(?:(?:\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s)[\p{L}\p{N}][\p{L}\p{N}-]*)*(?:\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s)\p{L}{2,}(?![\p{L}\p{N}-])",
    regex.I,
)
_NUMBER = regex.compile(r"(?<![\w@#/.\\=&-])(?:\p{Lu}{1,5}[ -]?)?(?:\+\s?)?\(?\d(?:[ ./-]?[ (]?\d\)?)*\d?(?:[ -]?\p{Lu}{1,3})?(?![\w@\\]|[./-]\w)")
_NAME = regex.compile(rf"(?<![\p{{L}}\p{{N}}@_/.\\-])(?:{_CAP}(?:\s(?:{_CAP}|\p{{Lu}}\.(?=\s\p{{Lu}})|(?:{'|'.join(PARTICLES)})(?=\s\p{{Lu}}\p{{Ll}})))*(?:,\s{_CAP}(?![\p{{L}}]))?|{_CAPS}(?:[ ](?:{_CAPS}|\p{{Lu}}\.(?=[ ]\p{{Lu}})))*)(?![\p{{L}}\p{{N}}@_])".replace(r"\s", "[ ]"))
#: Digits in words.
DIGIT_WORDS = "zero oh one two three four five six seven eight nine null eins zwei drei vier fünf sechs sieben acht neun zéro un deux trois quatre cinq sept huit neuf cero uno dos tres cuatro cinco seis siete ocho nueve due tre quattro cinque sei sette otto nove".split()
_SPELLED = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:(?:plus|double)[ ])?(?:(?:{'|'.join(DIGIT_WORDS)})[ ,-]{{1,2}}){{6,}}(?:{'|'.join(DIGIT_WORDS)})(?![\p{{L}}\p{{N}}])", regex.I)
_TOKEN = regex.compile(r"<email>|[\p{L}\p{M}'’]+|\d+|\n+|[^\s\p{L}\p{M}\d]")
_LOWER = regex.compile(r"(?<![\p{L}\p{N}@._'’-])[\p{Ll}\p{M}]{2,}(?:-[\p{Ll}\p{M}]+)*(?![\p{L}\p{N}@_])")
_DIGIT = regex.compile(r"\d")
_OPENERS = frozenset(("^", "⏎", ":", "-", "*", "•", '"', "“", "„", "«", "¿", "¡", ">", "|"))
_INITIAL = regex.compile(r"\p{Lu}\.")
_PART = regex.compile(r"[^\s,]+")
_LABEL = regex.compile(rf"\b(?:{ID_LABELS})\b", regex.I)

#: Candidates, and with the kind `word` a word's occurrences in a batch: small (start), capital at a sentence's start (stop), capital elsewhere (seed, as text).
CANDIDATES = T.StructType(
    [T.StructField("msg_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("found", T.StringType())]
    + [T.StructField("words", T.ArrayType(T.StringType())), T.StructField("patterns", T.ArrayType(T.StringType())), T.StructField("seed", T.StringType()), T.StructField("inner", T.BooleanType())]
)


class _Context:
    """The tokens of a text with their places; an e-mail address is one token."""

    def __init__(self, text: str, emails: list[tuple[int, int]]):
        self.tokens: list[str] = []
        self.starts: list[int] = []
        self.stops: list[int] = []
        at, ends = 0, [*emails, (len(text), len(text))]
        for a, b in ends:
            for m in _TOKEN.finditer(text, at, a):
                t = m.group()
                self.tokens.append("⏎" if t[0] == "\n" else "0" if t.isdigit() else t.lower())
                self.starts.append(m.start())
                self.stops.append(m.end())
            if b > a:
                self.tokens.append("<email>")
                self.starts.append(a)
                self.stops.append(b)
            at = b

    def left(self, start: int) -> list[str]:
        """The last three tokens before a candidate, back to the sentence's start."""
        out: list[str] = []
        i = bisect_right(self.stops, start) - 1
        while i >= 0:
            t = self.tokens[i]
            i -= 1
            if t == "⏎":
                out.append(t)
                continue
            if t in ".!?" or (out and out[-1] == "⏎"):
                out.append(t if t in ("<email>", ",") else "^")
                break
            out.append(t)
            if len(out) == 3:
                break
        if len(out) < 3 and (not out or out[-1] != "^"):
            out.append("^")
        return out[::-1]

    def right(self, stop: int) -> list[str]:
        """The next two tokens after a candidate, up to the sentence's end."""
        out: list[str] = []
        for t in self.tokens[(i := bisect_left(self.starts, stop)) : i + 3]:
            if out and out[-1] == "⏎" and t != "⏎":
                out.append("<email>" if t == "<email>" else "$")
                break
            if t in ".!?":
                out.append(t if t != "." else "$")
                break
            out.append(t)
            if len(out) == 2:
                break
        return out or ["$"]

    def patterns(self, kind: str, start: int, stop: int, lead: str = "") -> list[str]:
        """Patterns of the words on both sides, of three and two before, and of two after. lead: a token between them and the candidate."""
        left, right = self.left(start), self.right(stop)
        if lead:
            left = [*left, lead]
        l3, l2, r2 = " ".join(left[-3:]), " ".join(left[-2:]), " ".join(right)
        out = [] if l3 in ("^", "⏎ ^", "^ ⏎") and r2 in ("$", "⏎ $", ",", "!", "?", "the", "⏎ ⏎") else [f"{kind}|{l3}|{r2}"]
        if l2 not in ("^", "^ the", "⏎ ^", "^ ⏎"):
            out += [f"{kind}|{l3}|", f"{kind}|{l2}|"]
        if r2 not in ("$", ",", "!", "?") and (r2[0] != "⏎" or "<email>" in r2):
            out.append(f"{kind}||{r2}")
        return list(dict.fromkeys(out))


def _skeleton(found: str) -> str:
    return regex.sub(r"\p{Lu}", "A", regex.sub(r"\d", "0", found))


def _number_seed(found: str, near: str) -> str:
    """What the number is by itself or by a label before it in its sentence: a phone, an identity number, or unknown."""
    near = regex.split(r"(?<=[!?])\s|\n|(?<!no)\.\s", near)[-1]
    if _LABEL.search(near):
        return "id_number"
    digits = sum(c.isdigit() for c in found)
    if found.startswith("+") and 8 <= digits <= 15 or regex.fullmatch(r"\(\d{2,5}\) ?\d{3,4}[- ]?\d{3,4}", found):
        return "phone"
    return ""


def _runs(parts: list, comma: int) -> Iterator[tuple[int, int]]:
    """Every run of parts that may be a name: up to NAME_WORDS words, particles and initials between them free. comma: the part before a comma, or -1."""
    full = [not (p.group() in PARTICLES or _INITIAL.fullmatch(p.group())) for p in parts]
    for k in range(len(parts)):
        if not full[k] and parts[k].group() not in PARTICLES:
            continue
        n = 0
        for end in range(k, len(parts)):
            n += full[end]
            if n > NAME_WORDS or (comma >= 0 and end == comma + 1 and k < comma and not full[k]):
                break
            if full[end]:
                yield k, end + 1


def propose(text: str, small: Counter | None = None, capital: Counter | None = None, inside: Counter | None = None) -> list[tuple]:
    """(kind, start, stop, found, words, patterns, seed, inner) of every candidate of a text.

    E-mail addresses, addresses with a street word and numbers in words are seeds. Numbers are proposed once and get their
    kind from seeds or patterns. Of capitalised words every run of up to NAME_WORDS words is proposed; inner: not at the
    start of a sentence. small, capital and inside take the counts of words outside all other values: small ones, those that
    begin a sentence, and capital ones elsewhere.
    """
    out, taken = [], bytearray(len(text))
    free = lambda a, b: taken.find(1, a, b) < 0

    def take(a: int, b: int) -> None:
        taken[a:b] = b"\1" * (b - a)

    emails = []
    for m in _EMAIL.finditer(text):
        out.append(("email", m.start(), m.end(), m.group(), [], [], "email", True))
        take(*m.span())
        emails.append(m.span())
    around: _Context | None = None

    def context() -> _Context:
        nonlocal around
        around = around or _Context(text, emails)
        return around

    if _DIGIT.search(text):
        for pattern, seed in ((_ADDRESS, "address"), (_LOOSE_ADDRESS, "")):
            for m in pattern.finditer(text):
                if free(*m.span()):
                    out.append(("address", m.start(), m.end(), m.group(), [], context().patterns("address", *m.span()), seed, True))
                    if seed:
                        take(*m.span())
        for m in _NUMBER.finditer(text):
            found = m.group().rstrip(" -./(")
            if sum(c.isdigit() for c in found) >= 5 and free(m.start(), m.start() + len(found)):
                start, stop, lead = m.start(), m.start() + len(found), ""
                if found.startswith("(") and found.count("(") > found.count(")"):
                    found, start, lead = found[1:], start + 1, "("
                at = bisect_right(context().stops, start)
                near = text[context().starts[max(0, at - LABEL_TOKENS)] : start] if at else ""
                seed = _number_seed(found, near)
                label = regex.match(r"\p{Lu}{2,5} (?=[\d(+])", found)
                if label and (_LABEL.fullmatch(label.group().strip()) or not seed):  # a label in capitals isn't part of the number
                    start, found, near = start + label.end(), found[label.end() :], near + label.group()
                    lead, seed = label.group().strip().lower(), _number_seed(found, near)
                out.append(("number", start, stop, found, [_skeleton(found)], context().patterns("number", m.start() if lead else start, stop, lead), seed, True))
                if seed:
                    take(start, stop)
    for m in _SPELLED.finditer(text):
        if free(*m.span()):
            out.append(("number", *m.span(), m.group(), ["spelled"], context().patterns("number", *m.span()), "phone", True))
            take(*m.span())
    pieces, at = [], 0
    while (a := taken.find(1, at)) >= 0:
        b = taken.find(0, a)
        b = len(text) if b < 0 else b
        pieces += [text[at:a], "\0" * (b - a)]
        at = b
    open_text = "".join(pieces) + text[at:]
    if small is not None:
        small.update(_LOWER.findall(open_text))
    for m in _NAME.finditer(open_text):
        parts = list(_PART.finditer(m.group()))
        comma = next((i for i, p in enumerate(parts) if m.group()[p.end() : p.end() + 1] == ","), -1)
        words = ["" if p.group() in PARTICLES or _INITIAL.fullmatch(p.group()) else p.group().lower().rstrip(".") for p in parts]
        opens = context().left(m.start())[-1] in _OPENERS
        if capital is not None:
            capital.update(w for w in words[:opens] if w)
            inside.update(w for w in words[opens:] if w)
        for k, end in _runs(parts, comma):
            own = [w for w in words[k:end] if w]
            if own[0] in TITLES:
                continue
            a, b = m.start() + parts[k].start(), m.start() + parts[end - 1].end()
            out.append(("name", a, b, text[a:b], own, context().patterns("name", a, b), "", k > 0 or not opens))
    return out


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.bool_())
    for b in batches:
        small: Counter[str] = Counter()
        capital: Counter[str] = Counter()
        inside: Counter[str] = Counter()
        rows = [(i, *c) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for c in propose(t, small, capital, inside)]
        rows += [(None, "word", small[w], capital[w], w, None, None, str(inside[w]), None) for w in small.keys() | capital.keys() | inside.keys()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names=CANDIDATES.names)


def _rate(edges: DataFrame, scores: DataFrame, by: str) -> DataFrame:
    """(pattern, p): each pattern's share of rated instances, of those with LEAST rated ones."""
    joined = edges.join(scores, by, "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    return joined.groupBy("pattern").agg((F.sum("s") / (F.count("*") + F.lit(1.0))).alias("p"), F.count(F.when(F.col("s") >= 0.5, 1)).alias("n")).where(F.col("n") >= LEAST).select("pattern", "p")


def _names(cand: DataFrame, known: DataFrame, rounds: int) -> DataFrame:
    """The found names. Words rate runs of words, runs rate patterns, patterns rate words.

    All is kept by kinds of occurrence: a run of words with its patterns, and how often it occurs. A word's score is the share
    of its occurrences inside sentences, small ones too, that stand in rated patterns. Where a sentence begins with it, its capital
    says nothing; up to FIRSTS such occurrences count, and a word that hardly stands anywhere else scores less, so that
    the words which sentences begin with don't become names by standing beside one. Seeds score 1.
    """
    tally = cut(cand.where("kind = 'word'").groupBy(F.col("found").alias("word")).agg(F.sum("start").alias("n_small"), F.sum("stop").alias("n_first"), F.sum(F.col("seed").cast("long")).alias("n_inside")), "tally")
    seeds = known.select(F.explode(F.split(F.lower("name_text"), r"[\s]+")).alias("word")).where("word <> ''").distinct()
    names = cand.where("kind = 'name'").select("msg_id", "start", "stop", "found", "words", "patterns", "inner").withColumn("run", F.array_join("words", " "))
    names = names.withColumn("id", F.xxhash64("run", F.array_join("patterns", "\0"), "inner"))
    kinds = cut(names.groupBy("id", "run", "words", "patterns", "inner").agg(F.count("*").alias("n")), "kinds")
    edges = cut(kinds.select("run", "id", F.explode("patterns").alias("pattern")), "edges")
    instances = edges.select("run", "pattern").distinct()
    placed = cut(kinds.select("id", "run", "n", "inner", F.posexplode("words").alias("at", "word")).select("id", "run", "n", "word", "at", (F.col("inner") | (F.col("at") > 0)).alias("inner")), "placed")
    parts = cut(placed.select("run", "word").distinct(), "parts")
    common = tally.where("n_small * 2 > n_first + n_inside").select("word", F.lit(True).alias("common"))
    plain = cut(parts.join(common, "word", "left").groupBy("run").agg(F.max("common").alias("c")).where("c is null").select("run"), "plain")
    plain_parts = cut(parts.join(plain, "run"), "plain-parts")
    lexicon = seeds.select("word", F.lit(1.0).alias("s"))
    rated = leads = None
    for _ in range(rounds):
        run_scores = plain_parts.join(lexicon, "word", "left").groupBy("run").agg(F.min(F.coalesce("s", F.lit(0.0))).alias("s"))
        rated = cut(_rate(instances, run_scores, "run"), "patterns")
        good = cut(edges.join(rated.where(F.col("p") >= SHARE), "pattern"), "good")
        # A word right before many whole names leads in to them and is none itself (as in "Ask ..."); before single family names it is a given name.
        left = F.element_at(F.split(F.element_at(F.split("pattern", r"\|"), 2), " "), -1)
        leads = good.select("pattern", "run", F.size(F.split("run", " ")).alias("k")).distinct().groupBy("pattern").agg(F.avg("k").alias("k"), F.count("*").alias("n")).where(f"k >= 1.5 and n >= {LEAST}").select(left.alias("word")).distinct().join(seeds, "word", "left_anti")
        stood = placed.join(good.select("id").distinct(), "id", "left_semi").groupBy("word").agg(F.sum(F.when(F.col("inner"), F.col("n")).otherwise(0)).alias("inner"), F.sum(F.when(F.col("inner"), 0).otherwise(F.col("n"))).alias("first"))
        firsts = lambda c: F.least(F.col(c), F.lit(FIRSTS))
        share = (F.least("inner", "n_inside") + firsts("first")) / (F.col("n_inside") + F.col("n_small") + F.least("n_first", F.lit(5 * FIRSTS)))
        elsewhere = (F.col("n_inside") + 1) / (F.col("n_inside") + F.col("n_first") + 1) / ELSEWHERE
        words = stood.join(tally, "word").select("word", (F.least(F.lit(1.0), share) * F.least(F.lit(1.0), elsewhere)).alias("s"))
        lexicon = cut(words.join(leads, "word", "left_anti").join(seeds, "word", "left_anti").union(seeds.select("word", F.lit(1.0).alias("s"))), "lexicon")

    both = F.col("pattern").rlike(r"\|[^|]+\|[^|]+$")
    told = edges.join(rated, "pattern").groupBy("id").agg(F.max("p").alias("p"), F.max(F.when(~F.col("pattern").rlike(r"\|\|"), F.col("p"))).alias("p_left"), F.max(F.when(both, F.col("p"))).alias("p_both"))
    scores = lexicon.join(common, "word", "full").join(leads.withColumn("lead", F.lit(True)), "word", "full").join(seeds.withColumn("seed", F.lit(True)), "word", "left")
    each = placed.select("id", "at", "word").join(scores, "word", "left")
    weak = F.col("common") & F.col("seed").isNull() | (F.coalesce("s", F.lit(0.0)) < WORD)
    first = F.col("at") == 0
    run = each.groupBy("id").agg(
        F.count(F.when(weak, 1)).alias("n_weak"), F.count(F.when(weak & ~first, 1)).alias("rest_weak"), F.count("common").alias("n_common"), F.count(F.when(F.col("seed").isNull(), F.col("common"))).alias("new_common"),
        F.count("lead").alias("n_lead"), F.min(F.coalesce("s", F.lit(0.0))).alias("s"), F.count("*").alias("k"),
    )
    p, p_left, p_both = (F.coalesce(c, F.lit(0.0)) for c in ("p", "p_left", "p_both"))
    known_words = (F.col("n_weak") == 0) & ((F.col("k") >= 2) | ((F.col("n_common") == 0) & (p >= SHARE)) | (p >= SURE))
    new_words = (F.col("new_common") == 0) & (F.col("s") >= DOUBT) & (p >= SURE)
    mixed = (F.col("k") >= 2) & (F.col("rest_weak") == 0) & (p_left >= SURE)  # a common word before a name's word, inside a sentence
    single = (F.col("k") == 1) & (p_both >= SURE)
    strength = F.when(F.col("n_lead") > 0, 0).when(known_words | new_words | (single & (F.col("s") >= DOUBT)), 2).when(mixed | single, 1).otherwise(0)
    judged = run.join(told, "id", "left").select("id", strength.alias("strength")).where("strength > 0")
    found = names.join(judged, "id").where("strength > 1 or inner")
    return found.select("msg_id", F.lit("name").alias("kind"), "start", "stop", "found", F.lit(4).alias("rank"), "strength")


def _numbers(cand: DataFrame, rounds: int) -> DataFrame:
    """The found phone and identity numbers: seeds rate patterns, patterns rate forms of digits, and both tell about the numbers without a seed.

    A form's score is the share of its numbers that stand in rated patterns.
    """
    numbers = cand.where("kind = 'number'").select("msg_id", "start", "stop", "found", F.col("words")[0].alias("form"), "patterns", "seed")
    kinds = cut(numbers.groupBy("found", "form", "patterns", "seed").agg(F.count("*").alias("n")), "number-kinds")
    edges = cut(kinds.select("found", "form", "seed", F.explode("patterns").alias("pattern")).distinct(), "number-edges")
    each = ("id_number", "phone")
    forms = rated = None
    for _ in range(rounds):
        told = edges if forms is None else edges.join(forms, "form", "left")
        for k in each:
            by_form = F.lit(0.0) if forms is None else F.when(F.col("seed") == "", F.coalesce(f"f_{k}", F.lit(0.0))).otherwise(0.0)
            told = told.withColumn(f"s_{k}", F.when(F.col("seed") == k, 1.0).otherwise(by_form))
        shares = [F.when(F.count(F.when(F.col(f"s_{k}") >= 0.5, 1)) >= LEAST, F.sum(f"s_{k}") / (F.count("*") + F.lit(1.0))).otherwise(0.0).alias(k) for k in each]
        rated = cut(told.groupBy("pattern").agg(*shares), "number-patterns")
        by_number = edges.join(rated, "pattern").groupBy("found", "form", "seed").agg(*[F.max(k).alias(k) for k in each])
        forms = cut(by_number.groupBy("form").agg(*[F.avg(F.when((F.col("seed") == k) | (F.col(k) >= SHARE), 1.0).otherwise(0.0)).alias(f"f_{k}") for k in each]), "forms")
    open_numbers = numbers.where("seed = ''").select("msg_id", "start", "stop", "found", F.explode("patterns").alias("pattern")).join(rated, "pattern").groupBy("msg_id", "start", "stop", "found").agg(F.max("phone").alias("phone"), F.max("id_number").alias("id_number"))
    digits = F.length(F.regexp_replace("found", r"\D", ""))
    id_p, phone_p = F.coalesce("id_number", F.lit(0.0)), F.coalesce("phone", F.lit(0.0))
    kind = F.when((id_p >= SURE) & (id_p > phone_p), "id_number").when((phone_p >= SURE) & digits.between(7, 15) & ~F.col("found").rlike(r"[A-Za-z]"), "phone")
    sure = numbers.where("seed <> ''").select("msg_id", F.col("seed").alias("kind"), "start", "stop", "found")
    found = sure.union(open_numbers.withColumn("kind", kind).where("kind is not null").select("msg_id", "kind", "start", "stop", "found"))
    return found.select("*", F.lit(3).alias("rank"), F.lit(1).alias("strength"))


def _addresses(cand: DataFrame) -> DataFrame:
    """The found addresses: those with a street word rate patterns for those without."""
    places = cand.where("kind = 'address'")
    pairs = places.select(F.explode("patterns").alias("pattern"), "found", "seed").distinct()
    seeded = F.count(F.when(F.col("seed") == "address", 1))
    good = pairs.groupBy("pattern").agg((seeded / (F.count("*") + 1)).alias("p"), seeded.alias("n")).where((F.col("n") >= LEAST) & (F.col("p") >= SURE)).select("pattern")
    loose = places.where("seed = ''").select("msg_id", "start", "stop", "found", F.explode("patterns").alias("pattern")).join(good, "pattern").select("msg_id", F.lit("address").alias("kind"), "start", "stop", "found", F.lit(2).alias("rank")).distinct()
    sure = places.where("seed = 'address'").select("msg_id", "kind", "start", "stop", "found", F.lit(1).alias("rank"))
    return sure.union(loose).select("*", F.lit(1).alias("strength"))


def find_personal(turns: DataFrame, known: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(msg_id, kind, found, start, stop) of the personal data in `turns` (msg_id, content; one row an id).

    known: name_kind, name_text; a bounded list of seed names. Null and blank contents have none. Candidates
    never cross a line. The graph's edges are the distinct pairs of pattern and instance, aggregated before
    they are joined; no pattern's instances are gathered in one place. A word counts as common where it is written small more
    than half as often as large. A pattern counts from LEAST rated instances on, and with a share of at least SHARE; one of at
    least SURE tells about words and numbers that nothing else tells of. Of values that overlap the more specific one counts,
    then the longer. Names inside other values aren't listed.
    Without known names none but e-mail addresses, numbers and addresses are found.
    """
    texts = turns.where(F.col("content").rlike(r"(?U)\S")).select("msg_id", "content")
    cand = cut(texts.mapInArrow(_propose, CANDIDATES), "candidates")
    emails = cand.where("kind = 'email'").select("msg_id", "kind", "start", "stop", "found", F.lit(0).alias("rank"), F.lit(1).alias("strength"))
    every = emails.union(_addresses(cand)).union(_numbers(cand, rounds)).union(_names(cand, known, rounds))
    placed = every.repartition(width(turns.sparkSession), "msg_id").sortWithinPartitions("msg_id", "rank", F.col("start") - F.col("stop"), F.desc("strength"), "start")
    return placed.mapInArrow(_disjoint, "msg_id long, kind string, found string, start int, stop int")


def _disjoint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each turn's values without those inside or across one that comes before; the rows come sorted by turn and rank."""
    now, starts, stops = object(), [], []
    for b in batches:
        keep = []
        for r, (m, a, z) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())):
            if m != now:
                now, starts, stops = m, [], []
            i = bisect_right(starts, a)
            if (i == 0 or stops[i - 1] <= a) and (i == len(starts) or starts[i] >= z):
                starts.insert(i, a)
                stops.insert(i, z)
                keep.append(r)
        kept = b.take(pa.array(keep, type=pa.int64()))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), kept.column(4), kept.column(2), kept.column(3)], names=["msg_id", "kind", "found", "start", "stop"])


def turns(conversation: DataFrame) -> DataFrame:
    """(msg_id, content) of the distinct turns; turns without an id are left out."""
    return once(conversation.select("msg_id", "content").where("msg_id is not null and content is not null"), "msg_id")


def redact(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(msg_id, content, n_values) with every value found replaced by its kind in brackets, the rest as it was."""
    spans = found.groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind"))).alias("spans"))
    joined = texts.join(spans, "msg_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, n = [], []
            for text, marks in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts, at = [], 0
                for m in marks or []:
                    parts += [text[at : m["start"]], f"[{m['kind'].upper()}]"]
                    at = m["stop"]
                out.append("".join(parts) + text[at:])
                n.append(len(marks or []))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, type=pa.string()), pa.array(n, type=pa.int32())], names=["msg_id", "content", "n_values"])

    return joined.select("msg_id", "content", "spans").mapInArrow(run, "msg_id long, content string, n_values int")
