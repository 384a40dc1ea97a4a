import random

import numpy as np
import pytest
from conftest import rows

from millrace.llm.personal_data import find_personal, propose, redact
from millrace.llm.reading_level import reading_levels
from millrace.llm.text_stats import STATS, layout, measure, text_quality, vector

PROSE = ["The share of labels fell after lunch, and nobody looked at the list.", "We sorted the notes yesterday and kept the warm ones.", "It helps to compare the clusters before the next run starts.", "Every caption names the pose, the setting and the light."]
SHAPES = {
    "list": ["- the filter list\n- useful labels\n- balanced presets\n- export it", "close shot, mid shot, warm light, standing, portrait, a red hat, 35mm", "1. sort the notes\n2. the cache\n3. export the labels\n4. rest", "[x] the split\n[ ] the cache of labels\n[x] warm light\n[ ] the preset"],
    "table": ["a,b,c\n1,close,0.2\n2,far,0.3\n3,mid,0.4\n4,far,0.95", "| file | shot |\n|---|---|\n| a.png | close |\n| b.png | far |", "img_1   close   0.3   yes\nimg_2   far   0.9   no\nimg_3   mid   0.1"],
    "junk": ["9f" * 60, "QmFzZTY0" * 20, "na " * 40, "h" * 90, "%$/{=}[" * 20, "xlqf xnahn dnn dvhqb nxmsxbx lch htmh sgr kvpdbnqcn"],
}
NOT_SHAPED = [" ".join(PROSE), "\n".join(PROSE), PROSE[0] + " " + PROSE[1] + "\n- merge it\n- sort it\n" + PROSE[2], "it was a hot day\nwe saw the dog\nhe did not see the cat\nshe has a map\ncan you see it", "これは長い文章です。次に学習データを確認しました。残りは五枚です。もう一度やり直してください。それから説明文を整理しました。", "The prints go to Bill Moor, 88 Salt Avenue, Apt 17, Tamber, 57305."]


@pytest.mark.parametrize("kind", sorted(SHAPES))
def test_shapes(kind):
    assert [layout(measure(t)[1]) for t in SHAPES[kind]] == [kind] * len(SHAPES[kind])


def test_prose_has_no_shape():
    assert [layout(measure(t)[1]) for t in NOT_SHAPED] == [None] * len(NOT_SHAPED)


def test_statistics_are_finite():
    for t in ("", " ", "x", "🙂", "a" * 100_000, "\x00\n\t", "|||", "日本"):
        s = vector(measure(t)[1])
        assert len(s) == len(STATS) and np.isfinite(s).all()


def test_quality_operator(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(PROSE) for _ in range(4)) for _ in range(300)] + SHAPES["list"] + SHAPES["junk"] + [None, " ", "short"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, text string, lang int")
    out = {x.id: x for x in text_quality(df, ["id"], "text").collect()}
    assert len(out) == len(texts) - 2 and all(out[i].shape is None for i in range(300))
    assert [out[300 + i].shape for i in range(4)] == ["list"] * 4 and [out[304 + i].shape for i in range(6)] == ["junk"] * 6
    assert abs(sum(out[300].parts) - out[300].d2) < 1e-6 * out[300].d2
    assert text_quality(df.limit(0), ["id"], "text").count() == 0


KNOWN = [("given", g) for g in ("Anna", "Bill", "Vera", "Jonas")] + [("family", f) for f in ("Moor", "Ashgrove", "Lindt")]


def conversation():
    out = []
    for i, (g, f) in enumerate((g, f) for g in ("Anna", "Bill", "Vera", "Jonas", "Tomke") for f in ("Moor", "Ashgrove", "Lindt", "Brennig")):
        out += [f"Ask {g} {f} about the folder.", f"Thanks, {g}!", f"My number is +44 7700 9000{i:02d}.", f"I live at {i + 1} Elm Street, Norham, 123{i:02d}.", f"SSN 9012233{i:02d} is mine."]
    out += ["My number is 5550001234.", "The seed was 5550001234.", "Version 8.91.8772 is fine.", "mail me: a.b+c@x-y.example, please", "Either tom at example dot com or later.", "Meet me at noon dot, at the usual place.", "Golden Hour works best.", "Mark the rose pictures.", "Ask about it.", "ask tomorrow about it, thanks a lot", "(cc k(at)oster(dot)test)", "Text nine six eight five five five zero one if it stops.", None, " ", "x" * 200_000]
    return out


def test_personal_data(spark):
    texts = conversation()
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "msg_id long, content string, kind string").select("msg_id", "content")
    known = spark.createDataFrame(KNOWN, "name_kind string, name_text string")
    found = find_personal(df, known)
    got = {(x.kind, x.found) for x in found.collect()}
    assert {("name", "Tomke Brennig"), ("name", "Anna Moor"), ("name", "Tomke"), ("email", "a.b+c@x-y.example"), ("email", "tom at example dot com"), ("email", "k(at)oster(dot)test"), ("address", "3 Elm Street, Norham, 12302"), ("id_number", "901223305"), ("phone", "+44 7700 900003"), ("phone", "5550001234"), ("phone", "nine six eight five five five zero one")} <= got
    assert not {f for _, f in got} & {"8.91.8772", "Golden Hour", "Mark", "Ask", "Norham"}
    assert all(k != "name" or f.split()[0] in ("Anna", "Bill", "Vera", "Jonas", "Tomke") for k, f in got)
    seed = texts.index("The seed was 5550001234.")
    out = {x.msg_id: x.content for x in redact(df.where("content is not null"), found).collect()}
    assert out[seed] == texts[seed] and out[0] == "Ask [NAME] about the folder." and out[3] == "I live at [ADDRESS]."
    assert find_personal(df.limit(0), known).count() == 0
    assert {k for k, _ in ((x.kind, x.found) for x in find_personal(df, known.limit(0)).collect())} <= {"email", "phone", "id_number", "address"}


GIVEN = "Odalys Bertil Sunniva Caspian Wren Halvard Nerea Quill Tamsin Iorek Linnea Dario Petra Soren Yara Milo Ines Rufus".split()
FAMILY = "Holloway Trevanion Bixby Lundqvist Marchetti Oduya Penrose Szabo Thackeray Verhoeven Kowal Aldersey Norring Fairweather Castellan Dupree".split()
PERSONAL = {
    "name": ["Please forward this to {n} before noon.", "The invoice was approved by {n} today.", "I met {g} at the gate.", "Kind regards, {n}", "Our new editor, {n}, starts soon.", "Bring {g} some water.", "We owe {g} an answer."],
    "phone": ["Ring the office at {p} any time.", "Fax goes to {p} as ever."],
    "id_number": ["Passport {i} has run out.", "her tax id is {i} now"],
    "address": ["Parcels reach me at {a} every day.", "The studio moved to {a} in May."],
    "email": ["write to {e} for the rest", "Reach us under {e} please."],
}
DECOYS = [
    "Order {d10} has shipped.", "Ticket {d10} is still open.", "Release 7.{d2}.{d4} fixes the crash.", "Each Monday the cache is cleared.", "It was quiet on Monday and late.", "The Legal Affairs desk is closed.", "Every January we clean the cache.", "Lisbon was warm in spring.", "The Canon Eos is heavy.", "Install Ubuntu Server first.", "Whenever the light fades, stop.",
    "Doctor visits take time.", "Professor was the title of the film.", "Kind regards,", "Serial {d10} was scanned.", "Between 1999-{d2}-11 and 2001-{d2}-12 it rained.", "Whenever a run ends, look again.", "Perhaps the label is wrong.", "Perhaps we should wait.", "Invoice {d10} was paid.", "We saw Legal Affairs leave.",
]
#: Words of decoys in the very place of a name.
TRAPS = ["Bring Monday some order.", "The form was approved by Legal Affairs today."]


def held_out(r):
    """Turns in templates and with decoys that no table has, and the values in them."""
    from string import digits

    d = lambda n: "".join(r.choice(digits[1:]) for _ in range(n))
    texts, true = [], set()
    for i in range(900):
        kind = r.choice(list(PERSONAL))
        g, f = r.choice(GIVEN), r.choice(FAMILY)
        values = {"n": f"{g} {f}", "g": g, "p": r.choice([f"+31 20 {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}", d(10)]), "i": r.choice("KLM") + d(8), "a": f"{d(2)} {r.choice(FAMILY)} {r.choice(['Street', 'Road', 'Lane'])}, {r.choice(['Utrow', 'Belmond'])}, {d(5)}", "e": f"{g.lower()}.{f.lower()}@{r.choice(['mail', 'post'])}.example"}
        template = r.choice(PERSONAL[kind])
        texts.append(template.format(**values))
        true.add((i, kind, values[template[template.index("{") + 1]]))
        if r.random() < 0.3:
            texts[-1] += "\n" + r.choice(DECOYS).format(d10=d(10), d2=d(2), d4=d(4))
    texts += [t.format(d10=d(10), d2=d(2), d4=d(4)) for t in DECOYS for _ in range(25)]
    texts += TRAPS * 3
    return texts, true


def test_personal_data_in_templates_unseen(spark):
    texts, true = held_out(random.Random(12))
    known = spark.createDataFrame([("given", g) for g in GIVEN[:8]] + [("family", f) for f in FAMILY[:6]], "name_kind string, name_text string")
    df = spark.createDataFrame(list(enumerate(texts)), "msg_id long, content string")
    got = {(x.msg_id, x.kind, x.found) for x in find_personal(df, known).collect()}
    figures = {k: (len([1 for x in got & true if x[1] == k]), len([1 for x in got if x[1] == k]), len([1 for x in true if x[1] == k])) for k in PERSONAL}
    assert all(both >= 0.95 * given and both >= 0.95 * there for both, given, there in figures.values()), (figures, sorted(got - true, key=str)[:20], sorted(true - got, key=str)[:20])


def test_runs_of_capitals_of_any_length():
    text = "Notes On The Long Road Home By Tomke Ida Brennig And Others, in two parts"
    got = {c[3] for c in propose(text) if c[0] == "name"}
    assert {"Tomke Ida Brennig", "Brennig", "Notes On The Long"} <= got and "Notes On The Long Road" not in got


def test_proposals_keep_to_the_value():
    one = lambda t, k: [c[3] for c in propose(t) if c[0] == k]
    assert one("The contact is <a_b@x.test>.", "email") == ["a_b@x.test"]
    assert one("at 12 avenue du Vieux Moulin, Valcendre.", "address") == ["12 avenue du Vieux Moulin, Valcendre"]
    assert one("to Flat 9, 58 Lantern Road, Norham ZZ2 5QQ in spring", "address") == ["Flat 9, 58 Lantern Road, Norham ZZ2 5QQ"]
    assert one("at Am Kornfeld 64, 04747 Brückstadt. Then", "address") == ["Am Kornfeld 64, 04747 Brückstadt"]
    assert propose("") == [] and propose("\n\n") == []


EASY, HARD, MID = ["the cat", "a dog", "we saw", "the sun", "mum has", "a hat", "it was", "fun day"], ["the posterior", "covariance of", "asymptotic regimes", "orthogonal criterion", "latent manifold", "it presupposes"], ["the folder", "a label", "the run", "we sorted", "the notes", "it helps", "the list"]


def text_of(r, parts, n=60):
    return " ".join(r.choice(parts) for _ in range(n)).capitalize() + "."


def test_reading_levels(spark):
    r = random.Random(8)
    ref = [(i, k, text_of(r, p)) for i, (k, p) in enumerate([("easy", EASY), ("medium", MID), ("hard", HARD)] * 6)]
    truth = {i: k for i, (k, _) in enumerate([("easy", EASY), ("medium", MID), ("hard", HARD)] * 30)}
    docs = [(i, text_of(r, {"easy": EASY, "medium": MID, "hard": HARD}[k] + ["the and of"])) for i, k in truth.items()]
    odd = [(900, None), (901, ""), (902, "Too short to tell."), (903, "das ist nicht gut und " * 40), (904, "img,close,0.3\n" * 80), (0, docs[0][1])]
    df = spark.createDataFrame([(*d, "hard") for d in docs + odd], "doc_id long, text string, level_name string")
    reference = spark.createDataFrame(ref, "ref_id long, level_name string, text string")
    got = {x.doc_id: x.level_name for x in reading_levels(df, reference).collect()}
    assert set(got) == set(truth) and sum(got[i] == truth[i] for i in truth) >= 0.95 * len(truth)
    assert rows(reading_levels(df.limit(0), reference)) == []
    assert set(x.level_name for x in reading_levels(df, reference.limit(0)).collect()) <= {"easy", "medium", "hard"}
