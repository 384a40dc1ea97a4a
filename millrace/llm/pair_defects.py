"""Broken prompt and response pairs, each with the kind of its defect (problem 2).

Copies show when an answer is compressed with its prompt as a zstandard dictionary. Refusals and
languages come from dictionaries. Whether a text without a closing mark breaks off is told by a
terminal-context model: how often its last words end a sentence elsewhere, and how often they go on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Container, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.language import asked_language, language
from millrace.llm.text_stats import layout, measure
from millrace.plans.runtime import cut, once, spread

DEFECTS = ("empty", "copy", "refusal", "other_language", "truncated")
#: Bits of the map of the last words asked for, and contexts that a task holds before it hands them on; neither changes a result.
ASKED_BITS, HELD = 1 << 20, 500_000
#: Parameter: an answer is a copy if at most one word in so many of its prompt is another one.
CHANGED = 8
#: Parameter: an answer of at most so many words breaks off only at a word that never ends a sentence; its words tell no context.
FEW_WORDS = 4
#: Bare words, and words in brackets, that stand for no answer.
BARE_PLACEHOLDERS = frozenset("none null nil nan n/a n.a. undefined tbd todo void #n/a".split())
BRACKETED_PLACEHOLDERS = frozenset(("none", "null", "nil", "n/a", "empty", "blank", "missing", "no response", "no answer", "no reply", "no output", "no content", "no text", "not available", "not answered", "deleted", "removed", "silence", "placeholder", "answer", "response", "your answer here", "keine antwort", "sin respuesta", "pas de réponse", "nessuna risposta", "нет ответа", "回答なし", "無回答"))
#: What is left of an answer that only hands its prompt back.
LEAD_INS = frozenset("you asked question prompt q user human your was the asks asked request said frage sie fragten vous avez demandé pregunta preguntaste domanda hai chiesto вопрос вы спросили 質問".split())
#: Phrases that decline, by language; spaces match any blanks.
REFUSALS = (
    r"(?:can'?t|cannot|can not|couldn'?t|could not|unable to|not able to|won'?t be able to|will not be able to|not in a position to|no way of) (?:\w+ )?(?:help|assist|answer|answering|respond|responding|reply|do that|do this|comply|provide|give you|share|discuss|talk about|fulfil|fulfill|engage|process|support|go into)",
    r"not something (?:that )?(?:i'?m|i am) (?:able|allowed|permitted|willing)|not (?:possible|permitted|allowed) for me to|(?:do not|don'?t|doesn'?t|does not) (?:permit|allow) me to|(?:i am|i'?m) not (?:allowed|permitted) to",
    r"(?:must|have to|need to|will|going to) (?:respectfully |politely )?(?:decline|refuse|turn (?:this |that |it )?down|pass on)|i (?:respectfully |politely )?(?:decline|refuse) to|i(?:'d| would) (?:rather|prefer) not|prefer not to",
    r"(?:don'?t|do not) feel comfortable|not comfortable (?:with )?(?:answering|discussing|talking|sharing)|(?:falls|is|lies) outside (?:of )?(?:what|my)|^\W*no comment|against my (?:guidelines|policy|policies|rules|programming)",
    r"(?:kann|darf|möchte|will) ich (?:\w+ )?(?:leider )?nicht (?:\w+ )?(?:helfen|beantworten|antworten|weiterhelfen|behilflich|bearbeiten|erfüllen)|(?:kann|darf) (?:dir|ihnen|das|dies|diese \w+) (?:\w+ )*nicht|muss ich (?:leider )?(?:ablehnen|verweigern|passen)|ich (?:lehne|muss) .{0,40}\bab(?:lehnen)?\b|nicht möglich, (?:ihnen|dir|diese)",
    r"je ne peux (?:malheureusement )?(?:pas|rien)|il ne m'est pas possible|je dois (?:malheureusement )?(?:refuser|décliner)|je refuse de|je ne suis pas en mesure|je préfère ne pas",
    r"no (?:te |le |les )?puedo (?:ayudar|responder|contestar|atender|hacer|dar|cumplir)|no me es posible|(?:debo|tengo que) (?:rechazar|declinar|negarme)|no estoy en condiciones|prefiero no (?:responder|contestar|hablar)|me niego a",
    r"non (?:ti |vi |le )?posso (?:aiutar|risponder|farlo|dare|soddisfare|fornire)|non mi è possibile|(?:devo|sono costretto a) (?:rifiutare|declinare)|non sono in grado|preferisco non",
    r"не (?:могу|смогу|можем) (?:\w+ )*(?:помочь|ответить|отвечать|выполнить|обсуждать)|вынужден\w* (?:\w+ )?отказать|отказываюсь|должен отказать|не имею возможности",
    r"お答えできません|お答えすることはできません|答えられません|お手伝いできません|お手伝いすることはできません|対応できません|回答できません|お断り|お受けできません|応じられません|応じることはできません|できかねます|お応えできません|助けることはできません",
)
#: Phrases that only go around a refusal.
CLOSERS = r"let me know|hope you (?:will )?understand|try (?:a|another|something) |anything else|something else|somebody else|someone else|different question|feel free|^\W*(?:i'?m |i am |so |very )*(?:sorry|regrettably|unfortunately|apologies|désolé|lo siento|mi dispiace|tut mir leid|извините|申し訳)|thank(?:s| you) for|i apologi[sz]e|as an? (?:ai|language model|assistant)"
_REFUSAL = regex.compile("|".join(r.replace(" ", r"\s+") if not r.startswith("お") else r for r in REFUSALS), regex.I | regex.M)
_CLOSER = regex.compile(CLOSERS, regex.I)
_QUOTED = regex.compile(r"[\"“„«「][^\"“”„«»「」]*[\"”“»」]")
_TAG = regex.compile(r"<[^<>\n]*>|&[a-zA-Z]{2,8};|&#\d+;")
_SPLIT = regex.compile(r"(?<=[.!?。！？])\s*(?=\S)|\n+")
_ALNUM = regex.compile(r"[\p{L}\p{N}]")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}'’]+")
_END = regex.compile(r"[.!?…。．！？](?:[\"'”’»)\]}）」』*_`]|\p{So}|\s)*$|[\"”»」』]$|(?:```|>)$")
_DOTS = regex.compile(r"(?:\.{2,}|…|。{2,}|・{2,})[\s\"'”’»)」]*$")
_TRAIL = regex.compile(r"(?:\s|\p{So}|(?!`)\p{Sk}|\p{Cf}|️)+$")
_KANA = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Han}]$")
#: Japanese particles and marks with which no sentence ends; words of several languages that never end one.
OPEN_KANA = "がをのはにでとへもやし、"
OPEN_WORDS = frozenset("the a an and or but of to in on at by for with from that which who than as if because so while when is are was be will und oder aber der die das den dem ein eine mit von für zu weil dass et ou mais le la les un une des du de pour avec que parce y o el los las con para por porque e il lo gli di per che perché и или но в на с для что потому".split())


def is_empty(text: str | None) -> bool:
    """Whether nothing in the text answers: no letters or digits, markup, a placeholder or an error marker."""
    if not text:
        return True
    bare = _TAG.sub(" ", text).strip().strip("﻿​‌‍").strip()
    if bare.startswith("[ERROR") or not _ALNUM.search(bare):
        return True
    low = " ".join(bare.lower().split())
    if low.strip(".!`*_'\"") in BARE_PLACEHOLDERS:
        return True
    inner = regex.fullmatch(r"[\[(<{*_`]+\s*(.*?)\s*[\])>}*_`]+\.?", low)
    return bool(inner and inner.group(1) in BRACKETED_PLACEHOLDERS | BARE_PLACEHOLDERS) or bool(regex.fullmatch(r"\[error\b.*\]", low))


def _plain(text: str) -> str:
    return " ".join(w.lower() for w in _WORD.findall(text))


def copied_bytes(prompt: str, answer: str) -> int:
    """Bytes that the answer takes beyond the prompt itself, both compressed with the prompt as dictionary."""
    import zstandard

    d = zstandard.ZstdCompressionDict(prompt.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    z = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    return len(z.compress(answer.encode())) - len(z.compress(prompt.encode()))


def is_copy(prompt: str, answer: str, most: int = 48) -> bool:
    """Whether the answer is only the prompt again, however spelled, quoted, led in or repeated, with one word in CHANGED another.

    The compressed size decides what is near the prompt at all: `most` bytes and one in CHANGED of the prompt's may be new.
    What is left without the prompt must then be lead-in words, and a word that differs must stand in the other's place,
    so that an answer made of the question's words isn't taken for it.
    """
    p, a = _plain(prompt), _plain(answer)
    if not p or not a or len(a) < 0.6 * len(p) or copied_bytes(p, a) > most + len(p) // CHANGED:
        return False
    rest = f" {a} "
    while f" {p} " in rest:
        rest = rest.replace(f" {p} ", "  ")
    if p in a and len(rest) == len(a) + 2:
        rest = a.replace(p, " ")  # scripts without blanks
    if rest.strip() == a:
        return len(a.split()) >= 4 and f" {a} " in f" {p} " or _nearly(p.split(), a.split())
    return all(w in LEAD_INS for w in rest.split())


def _nearly(prompt: list[str], answer: list[str]) -> bool:
    """Whether the answer is the prompt but for a few words, each with another in its place, and lead-in words."""
    left = len(prompt) // CHANGED
    for kind, i, j, x, y in SequenceMatcher(None, prompt, answer, autojunk=False).get_opcodes():
        if kind == "replace" and j - i == y - x:
            left -= j - i
        elif kind != "equal" and (kind != "insert" or not all(w in LEAD_INS for w in answer[x:y])):
            return False
    return left >= 0


def is_refusal(answer: str) -> bool:
    """Whether the answer declines and nothing in it answers; quoted refusals don't count."""
    text = _QUOTED.sub(' "" ', answer.replace("’", "'"))
    parts = [s for s in _SPLIT.split(text) if _ALNUM.search(s)]
    return all(_CLOSER.search(s) or _REFUSAL.search(s) for s in parts) and any(_REFUSAL.search(s) for s in parts)


def main_language(text: str) -> str:
    """The language of most of the text, by sentences and without what it quotes; '' where nothing tells."""
    own = _QUOTED.sub(" ", text)
    text = own if len(_WORD.findall(own)) >= 3 else text
    share: Counter[str] = Counter()
    for s in _SPLIT.split(text):
        if lang := language(s):
            share[lang] += len(s)
    if not share:
        return ""
    best, n = share.most_common(1)[0]
    return best if n * 2 > sum(share.values()) else language(text) or best


@lru_cache(maxsize=4096)
def _wanted(prompt: str) -> str:
    """The language that the prompt asks for, or is in."""
    return asked_language(prompt) or main_language(prompt)


def in_other_language(prompt: str, answer: str) -> bool:
    """Whether the answer as a whole isn't in the language that the prompt asks for or is in."""
    wanted = _wanted(prompt)
    if not wanted or len(_WORD.findall(answer)) < 4 and len(_KANA.findall(answer[-1:])) == 0 and answer.isascii():
        return False
    got = main_language(answer)
    return bool(got) and got != wanted and {got, wanted} != {"zh", "ja"}


def contexts(text: str, asked: bytes | None = None) -> Iterator[tuple[str, bool]]:
    """The last words at every place of the text that ends a sentence (True) or goes on (False).

    asked: a map of the last words whose contexts of several words matter; all do without it.
    """
    for s in regex.split(r"(?<=[.!?。！？])\s+|\n+", text):
        w = [x.lower() if not x.isdigit() else "0" for x in _WORD.findall(s)]
        closed = bool(_END.search(s)) and not _DOTS.search(s)
        for i, x in enumerate(w):
            last = i + 1 == len(w)
            if last and not closed:
                continue
            for n in (1, 2, 3) if asked is None or asked[crc32(x.encode()) % ASKED_BITS] else (1,):
                if i + 1 >= n:
                    yield " ".join(w[i + 1 - n : i + 1]), last


class TerminalModel:
    """How often words end a sentence or go on, with their stems' letters for words not seen."""

    def __init__(self, ended: dict[str, int], went_on: dict[str, int], begun: Container[str] | None = None, tails: Container[str] | None = None):
        self.ended, self.went_on = ended, went_on
        words = {w for d in (ended, went_on) for w in d if " " not in w}
        self.begun = {w[:n] for w in words for n in range(3, len(w))} if begun is None else begun
        self.tails = {w[-3:] for w in words} if tails is None else tails

    def breaks_off(self, text: str) -> bool:
        """Whether a text without a closing mark stops where it would go on."""
        words = _WORD.findall(text)
        w = [x.lower() if not x.isdigit() else "0" for x in words]
        if not w:
            return False
        if _KANA.search(text):
            return text[-1] in OPEN_KANA
        if len(w) <= FEW_WORDS:
            return w[-1] in OPEN_WORDS and len(w) > 1
        return self.goes_on(w[-3:])

    def goes_on(self, w: list[str]) -> bool:
        """Whether a text whose last three words are `w` would go on."""
        last, open_word = w[-1], w[-1] in OPEN_WORDS
        if not self.ended.get(last, 0) + self.went_on.get(last, 0):
            return open_word or last in self.begun or last[-3:] not in self.tails
        for n, least in ((3, 4 if open_word else 8), (2, 4 if open_word else 6), (1, 1)):
            key = " ".join(w[-n:])
            e, m = self.ended.get(key, 0), self.went_on.get(key, 0)
            if e + m >= least or n == 1:
                return e < 0.02 * (e + m)


class Asked(TerminalModel):
    """Stands for a model that isn't fitted yet: keeps the last three words that were asked about."""

    def __init__(self):
        super().__init__({}, {})
        self.end: str | None = None

    def goes_on(self, w: list[str]) -> bool:
        self.end = " ".join(w)
        return False


def _last_words(text: str) -> str:
    """The end of a text with more words than any context has, or all of it."""
    pieces = text.rsplit(None, 2 * FEW_WORDS)
    return " ".join(pieces[1:]) if len(pieces) > 2 * FEW_WORDS else text


def is_truncated(answer: str, model: TerminalModel, shape_of: Callable[[], str | None]) -> bool:
    """Whether the answer breaks off: an open bracket or code block, an announced item, or an open context. shape_of: gives the answer's shape where it is needed."""
    text = _TRAIL.sub("", answer)
    if text.count("```") % 2:
        return True
    prose = regex.sub(r"```.*?```", "", text, flags=regex.S) if "```" in text else text
    if prose.count("(") > prose.count(")") and not regex.search(r"[:;]-?\($", prose) and not _END.search(prose):
        return True
    if "\n" not in text and _END.search(text) and not _DOTS.search(text):
        return False
    shape = shape_of()
    if shape == "table":
        return False
    if shape == "list":  # items need no closing mark
        tail = text.rsplit("\n", 1)[-1]
        return (_WORD.findall(tail.lower()) or [""])[-1] in OPEN_WORDS and model.breaks_off(tail)
    if regex.search(r"(?:[:,]|\w-)$", text):
        return True
    if _DOTS.search(text):  # trailing off: broken only where the words before would go on
        return model.breaks_off(_last_words(_DOTS.sub("", text)))
    if _END.search(text):
        return False
    tail = text.rsplit("\n", 1)[-1]
    if shape is None and "\n" in text and regex.match(r"\s*(?:[-*•·]|\d+[.)]|\w\)|\[[ x]\])\s", tail):
        return model.breaks_off(tail) if tail.split()[-1].lower() in OPEN_WORDS else False
    return model.breaks_off(_last_words(text))


def defect(prompt: str | None, answer: str | None, model: TerminalModel) -> str | None:
    """The answer's first defect in the order of DEFECTS, or None."""
    if is_empty(answer):
        return "empty"
    prompt = prompt or ""
    if is_copy(prompt, answer):
        return "copy"
    if is_refusal(answer):
        return "refusal"
    shape_of = lru_cache(1)(lambda: layout(measure(answer)[1]))
    if in_other_language(prompt, answer) and shape_of() in (None, "list"):
        return "other_language"
    return "truncated" if is_truncated(answer, model, shape_of) else None


def records(pairs: DataFrame, probe: DataFrame) -> DataFrame:
    """(src, rec_id, prompt, answer) of the distinct pairs and probe answers."""
    visible = r"[^\p{Z}\p{C}\s]"
    a = pairs.select(
        F.lit("pairs").alias("src"), F.col("pair_id").alias("rec_id"),
        F.when(F.col("instruction").rlike(visible), F.col("instruction")).otherwise(F.col("question")).alias("prompt"),
        F.when(F.col("response").rlike(visible), F.col("response")).otherwise(F.col("output")).alias("answer"),
    )
    b = probe.select(F.lit("probe_answers").alias("src"), F.col("answer_id").alias("rec_id"), "prompt", F.col("response").alias("answer"))
    return once(a.union(b), "src", "rec_id")


def _count(asked: bytes | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ended: Counter[str] = Counter()
        went_on: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            keys = list(ended.keys() | went_on.keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, type=pa.string()), pa.array([ended[k] for k in keys], type=pa.int64()), pa.array([went_on[k] for k in keys], type=pa.int64())], names=["key", "ended", "went_on"])
            ended.clear()
            went_on.clear()
            return out

        for b in batches:
            for text in b.column(0).to_pylist():
                for key, last in contexts(text, asked):
                    (ended if last else went_on)[key] += 1
                if len(ended) + len(went_on) > HELD:
                    yield counted()
        yield counted()

    return run


def count_contexts(rows: DataFrame, asked: bytes | None = None) -> DataFrame:
    """(key, ended, went_on): how often each context of the answers ends a sentence and goes on; their closing marks are the labels."""
    counted = spread(rows.where("answer is not null").select("answer")).mapInArrow(_count(asked), "key string, ended long, went_on long")
    return counted.groupBy("key").agg(F.sum("ended").alias("ended"), F.sum("went_on").alias("went_on"))


def fit_terminal(rows: DataFrame) -> TerminalModel:
    """The model of all answers in the driver's memory, for tables that fit there; `pair_defects` looks contexts up by joins."""
    got = count_contexts(rows).toPandas()
    return TerminalModel({k: v for k, v in zip(got.key, got.ended) if v}, {k: v for k, v in zip(got.key, got.went_on) if v})


def open_ends(ends: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of `ends` (end: three words, distinct, stored) after which the answers of `rows` would go on.

    The contexts of all answers are counted, those of several words where the last is one of those asked for (or has its place
    in the map of ASKED_BITS bits, all that comes to the driver). Each end is joined with its contexts, and with the beginnings and
    tails of known words where its last word isn't known.
    """
    last = F.element_at(F.split("end", " "), -1)
    asked = bytearray(ASKED_BITS)
    for r in ends.select(F.pmod(F.crc32(last.cast("binary")), F.lit(ASKED_BITS)).cast("int").alias("bit")).distinct().toLocalIterator():
        asked[r.bit] = 1
    counted = cut(count_contexts(rows, bytes(asked)), "contexts")
    seen = counted.select("key", "ended", "went_on", F.lit("context").alias("as"))
    words = counted.where("not contains(key, ' ')").select("key")
    flag = lambda c, kind: words.select(c.alias("key")).distinct().select("key", F.lit(1).cast("long").alias("ended"), F.lit(0).cast("long").alias("went_on"), F.lit(kind).alias("as"))
    begun = flag(F.explode(F.expr("transform(filter(sequence(0, length(key)), n -> n >= 3 and n < length(key)), n -> left(key, n))")), "begun")
    facts = seen.union(begun).union(flag(F.expr("right(key, 3)"), "tail"))
    look = lambda c, kind: F.struct(c.alias("key"), F.lit(kind).alias("as"))
    wanted = ends.select("end", F.explode(F.array(look(F.col("end"), "context"), look(F.expr("substring_index(end, ' ', -2)"), "context"), look(last, "context"), look(last, "begun"), look(F.expr("right(substring_index(end, ' ', -1), 3)"), "tail"))).alias("k")).select("end", "k.*")
    met = wanted.join(facts, ["key", "as"]).groupBy("end").agg(F.collect_list(F.struct("as", "key", "ended", "went_on")).alias("facts"))  # five at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for end, facts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                of = {kind: [f for f in facts or [] if f["as"] == kind] for kind in ("context", "begun", "tail")}
                model = TerminalModel({f["key"]: f["ended"] for f in of["context"]}, {f["key"]: f["went_on"] for f in of["context"]}, [f["key"] for f in of["begun"]], [f["key"] for f in of["tail"]])
                keep.append(model.goes_on(end.split(" ")))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, type=pa.bool_()))], names=["end"])

    return ends.join(met, "end", "left").select("end", "facts").mapInArrow(run, "end string")


def pair_defects(rows: DataFrame) -> DataFrame:
    """(src, rec_id, defect) of every record of `rows` (src, rec_id, prompt, answer), defect null where it is sound.

    One defect a record: empty before copy, refusal, other_language and truncated. Null answers are
    empty; a null prompt has no language and no copies. All records are judged, whole, and the terminal
    model is fitted on all answers: a record that it decides is judged first but for that, then by its last words.
    A small table is spread over the cores, a large one isn't shuffled beyond the fit.
    """
    rows = cut(rows, "pairs")
    schema = T.StructType([rows.schema["src"], rows.schema["rec_id"], T.StructField("defect", T.StringType()), T.StructField("end", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, ends = [], []
            for p, a in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                asked = Asked()
                out.append(defect(p, a, asked))
                ends.append(asked.end)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, type=pa.string()), pa.array(ends, type=pa.string())], names=schema.names)

    judged = cut(spread(rows.select("src", "rec_id", "prompt", "answer")).mapInArrow(run, schema), "judged")
    ends = cut(judged.where("end is not null").select("end").distinct(), "ends")
    late = open_ends(ends, rows).withColumn("late", F.lit("truncated"))
    return judged.join(late, "end", "left").select("src", "rec_id", F.coalesce("defect", "late").alias("defect"))
