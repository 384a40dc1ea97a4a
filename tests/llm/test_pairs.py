import random

import pytest
from conftest import rows

from millrace.llm import pair_defects as P
from millrace.llm.language import asked_language, language

SOUND = ["The run took an hour and the labels were late.", "We kept the sharp ones after the review.", "Please check the folder before the next run starts.", "It helps to sort the notes and to keep a copy of the list.", "Neither the list nor the cache needs to be checked again.", "I would sort the labels first and leave the rest for later.", "Most of the pictures were taken in the garden."]


@pytest.fixture(scope="module")
def model():
    ended, went_on = P.Counter(), P.Counter()
    for t in SOUND * 5:
        for k, last in P.contexts(t):
            (ended if last else went_on)[k] += 1
    return P.TerminalModel(dict(ended), dict(went_on))


@pytest.mark.parametrize("text", [None, "", " \n\t", "…", "--", "<p></p>", "<br/>&nbsp;", "```\n```", "N/A", "None", "[no response]", "(no answer)", "{}", "[ERROR: timed out]", "​", "??", '""'])
def test_empty(model, text):
    assert P.defect("How are you?", text, model) == "empty"


@pytest.mark.parametrize("text", ["When should I sort the labels?", "when should i sort the labels", '"When should I sort the labels?"', "You asked: When should I sort the labels?", "When  should  I  sort  the  labels?\nWhen should I sort the labels?", "WHEN SHOULD I SORT THE LABELS?"])
def test_copies(model, text):
    assert P.defect("When should I sort the labels?", text, model) == "copy"


@pytest.mark.parametrize("text", ["I'm sorry, but I can't help with that.", "As a language model, I am unable to answer this. I hope you understand.", "No comment. Please ask somebody else.", "Lo siento, no puedo ayudarte con eso.", "Diese Anfrage muss ich leider ablehnen.", "申し訳ありませんが、そのご質問にはお答えできません。", "i dont feel comfortable answering that, sorry Please try a different question."])
def test_refusals(model, text):
    assert P.defect("When should I sort the labels?", text, model) == "refusal"


@pytest.mark.parametrize("text", ["When should I sort the labels? We kept the sharp ones after the review.", "I'm sorry to hear that the run stopped. We kept the sharp ones after the review.", 'The filter drops every turn with "I can\'t help with that". It helps to sort the notes.', "You cannot skip the label pass here. Most of the pictures were taken in the garden.", "Yes.", "Four", "Option B", "No, not yet", "we kept the sharp ones after the review", "I would sort the labels first and leave the rest for later 🙂", 'In German that is "Am Ende ist die Liste fertig und kann verglichen werden." We kept it.', "Set it like this:\n```\nbatch = 2\n```", "- the list\n- the labels\n- the notes\n- the cache", "It helps to sort the notes (see the list)"])
def test_sound(model, text):
    assert P.defect("When should I sort the labels?", text, model) is None


@pytest.mark.parametrize("text", ["We kept the sharp ones and the", "It helps to sort the notes and to keep a copy of", "Most of the pictures were taken in the gard", "First: sort the notes. Second:", "It helps to sort the notes (for instance the", "Put this into the settings:\n```\nbatch = 7\nsteps =", "Please check the folder before the…", "設定を確認しました。次に画像フォルダを"])
def test_truncated(model, text):
    prompt = "どうですか？" if text[0] == "設" else "When should I sort the labels?"
    assert P.defect(prompt, text, model) == "truncated"


def test_languages(model):
    assert P.defect("When should I sort the labels?", "Am Ende ist die Liste fertig und kann verglichen werden.", model) == "other_language"
    assert P.defect("Answer in German, please: When should I sort it?", "Am Ende ist die Liste fertig und kann verglichen werden.", model) is None
    assert P.defect("Answer in German, please: When should I sort it?", "We kept the sharp ones after the review.", model) == "other_language"
    assert [language(t) for t in ("the cat is on the mat", "das ist nicht gut und auch nicht schön", "Группа готова", "これは本です", "12 --", "xkcd", "a9c700cf85c3b")] == ["en", "de", "ru", "ja", "", "", ""]
    assert asked_language("Write a short note in Spanish.") == "es" and asked_language("I was in Spain.") == ""


def test_near_copies(model):
    prompt = "Explain the resume log to somebody who has a mixed folder of night photos."
    assert P.is_copy(prompt, prompt.replace("somebody", "someone")) and P.is_copy(prompt, "You asked: " + prompt.lower().replace("mixed", "full"))
    assert not P.is_copy(prompt, prompt.replace("Explain the resume", "We like that old")) and not P.is_copy(prompt, prompt + " It lists what is done.")
    assert not P.is_copy("What is the blur score of the first image here?", "The blur score of the first image here is 12.")
    long = " ".join(f"word{i} of the list" for i in range(3000))
    assert P.is_copy(long, long.replace("word77 ", "ward77 ").replace("word1200 ", "werd ")) and not P.is_copy(long, long[: len(long) // 2])


def test_late_and_long_refusals(model):
    late = "I'm so sorry. Thank you for the question. I apologize for the trouble. I'm sorry once more. I can't help with that."
    assert P.is_refusal(late) and P.is_refusal("I can't help with that. " * 80)
    assert not P.is_refusal(late + " We kept the sharp ones after the review.") and not P.is_refusal("Thank you for the question.") and not P.is_refusal("")


def test_lists_are_judged(model):
    german = "- nicht ohne die Liste\n- auch mit der Karte\n- und noch ein Wort\n- das ist gut"
    assert P.in_other_language("When should I sort the labels?", german)
    assert P.layout(P.measure(german)[1]) == "list" and P.defect("When should I sort the labels?", german, model) == "other_language"
    assert P.is_truncated("- the list\n- the cache\n- a copy of the", model, lambda: "list") and not P.is_truncated("- the list\n- the cache\n- a copy", model, lambda: "list")


def test_model_learns_the_ends_of_long_answers(spark):
    rows_ = spark.createDataFrame([("s", 1, "We kept the sharp ones " * 250 + "with omega.")], "src string, rec_id long, answer string")
    assert P.fit_terminal(rows_).ended["omega"] == 1


def test_every_answer_is_in_the_model(spark):
    """A word that ends a sentence in one answer of many thousands is known, whichever answer it is."""
    sound = [("s", i, "When is it?", "We kept the sharp ones after the review.") for i in range(42_000)]
    odd = [("s", -1 - i, "When is it?", f"We kept the sharp ones after a zq{i}x.") for i in range(40)] + [("t", i, "When is it?", f"We kept the sharp ones after zq{i}x") for i in range(40)]
    table = spark.createDataFrame(sound + odd, "src string, rec_id long, prompt string, answer string")
    got = P.pair_defects(table).where("src = 't'").collect()
    assert len(got) == 40 and all(r.defect is None for r in got)


def test_looked_up_ends_are_judged_as_by_the_model(spark, model):
    texts = ["We kept the sharp ones after the review", "It helps to sort the notes and to keep the", "Most of the pictures were taken in the gard", "It helps to sort the notes and to keep zzz", "It helps to sort the notes and to keep unlabels", "I would sort the labels first"]
    answers = spark.createDataFrame([("s", i, "When is it?", t) for i, t in enumerate(SOUND * 5 + texts)], "src string, rec_id long, prompt string, answer string")
    got = {r.rec_id: r.defect for r in P.pair_defects(answers).collect()}
    assert [got[len(SOUND) * 5 + i] for i in range(len(texts))] == [P.defect("When is it?", t, P.fit_terminal(answers)) for t in texts]


def test_operator(spark):
    r = random.Random(1)
    sound = [(i, None, "When is it?", " ".join(r.choice(SOUND) for _ in range(3)), None) for i in range(300)]
    odd = [(1000, " ", "When is it?", "", "Yes."), (1001, "When is it?", None, None, None), (1002, None, None, "word " * 50_000 + "the", None), (1002, None, None, "word " * 50_000 + "the", None)]
    pairs = spark.createDataFrame([(*x, "s") for x in sound + odd], "pair_id long, instruction string, question string, response string, output string, src string")
    probe = spark.createDataFrame([(1, "When is it?", "When is it?")], "answer_id long, prompt string, response string")
    got = {(x.src, x.rec_id): x.defect for x in P.pair_defects(P.records(pairs, probe)).collect()}
    assert len(got) == 304 and got["pairs", 1000] is None and got["pairs", 1001] == "empty" and got["probe_answers", 1] == "copy"
    assert sum(got["pairs", i] is None for i in range(300)) == 300
    assert rows(P.pair_defects(P.records(pairs.limit(0), probe.limit(0)))) == []
