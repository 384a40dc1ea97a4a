import random
import unicodedata
from collections import Counter
from pathlib import Path

import pytest
from conftest import rows

from millrace.llm.term_frequency import answers, marked_terms, term_counts, terms
from millrace.llm.token_ids import BYTE_BPE, TOKENIZERS, Encoder, cuts, token_counts, token_ids

PATH = f"{TOKENIZERS}/{BYTE_BPE}"
needs_files = pytest.mark.skipif(not Path(PATH).exists(), reason="no tokenizer files here")


def test_terms_of_any_script():
    assert terms("Élan, ÉLAN x2-y") == ["élan", "élan", "x2", "y"]
    assert terms("ΟΔΟΣ 日本語 … ​") == ["οδος", "日本語"] and terms("") == []


def test_counts_match_brute_force(spark):
    r = random.Random(2)
    words = ["the"] * 30 + [f"w{i}" for i in range(40)] + ["Ünd", "ÜND"]
    data = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 40)))) for i in range(150)]
    df = spark.createDataFrame([(a, b, "x") for a, b in data + data[:40] + [(200, None), (None, "the end"), (None, "the end")]], "id long, text string, term string")
    occ, rec = Counter(), Counter()
    for _, t in data + [(None, "the end")]:
        found = [unicodedata.normalize("NFC", w).lower() for w in t.split()]
        occ.update(found)
        rec.update(set(found))
    assert rows(term_counts(df, "id", "text")) == sorted(((t, occ[t], rec[t]) for t in occ), key=repr)
    marks = {x.term: x.mark for x in marked_terms(df, "id", "text").collect()}
    n = len(data) + 1
    assert marks == {t: "rare" if k < 3 else "common" if k * 4 > n else None for t, k in rec.items()}


def test_empty_and_error_answers(spark):
    df = spark.createDataFrame([(1, "[ERROR: x]"), (2, None), (3, ""), (4, "yes")], "answer_id long, response string")
    assert [x.term for x in marked_terms(answers(df), "answer_id", "response").collect()] == ["yes"]
    assert term_counts(df.limit(0), "answer_id", "response").count() == 0


ODD = ["a" * 3000, "ab" * 900, "12" * 700, " " * 1500 + "x", "\n" * 900, "é" * 800, "don't" * 300, "日本語" * 400, "!?" * 500, "<|endoftext|> it", "🙂" * 300, "x̀" * 500, "", " "]


@needs_files
def test_tree_concatenation_is_exact():
    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    ref.encode_special_tokens = True
    r = random.Random(4)
    texts = ODD + ["".join(r.choice("abdest '\n1é日!🙂S") for _ in range(r.randrange(1, 1500))) for _ in range(60)] + ["".join(r.choice("abcdest") for _ in range(1200)) for _ in range(20)]
    enc = Encoder(PATH, whole=64)
    assert [enc.encode(t) for t in texts] == [e.ids for e in ref.encode_batch(texts, add_special_tokens=False)]
    assert b"".join(enc.bytes_of[i] for i in enc.encode(ODD[1])).decode() == ODD[1]


@needs_files
def test_segments_give_the_same_ids(spark):
    r = random.Random(6)
    texts = ODD + ["".join(r.choice("ab est '\n1é!") for _ in range(900)) for _ in range(10)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] * 2 + [(900, None, 1)], "doc_id long, text string, ids int")
    enc = Encoder(PATH)
    want = {i: enc.encode(t) for i, t in enumerate(texts)} | {900: []}
    for size in (40, 10_000):
        got = [(x.doc_id, x.ids) for x in token_ids(df, long_chars=size).collect()]
        assert len(got) == len(want) and dict(got) == want
    assert token_ids(df.limit(0)).count() == 0
    assert {x.doc_id: x.n_tokens for x in token_counts(df.select("doc_id", "text")).collect()} == {k: len(v) for k, v in want.items()}


def test_cuts_lie_where_the_pattern_cuts():
    for t in ("word " * 50, "a" * 500, "it's " * 60, " " * 300):
        places = cuts(t, 20)
        assert all(0 < i < len(t) for i, _ in places) and [i for i, _ in places] == sorted(i for i, _ in places)
