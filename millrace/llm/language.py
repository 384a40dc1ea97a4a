"""The language of a short text by script and function words."""

from __future__ import annotations

from collections import Counter

import regex

#: Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to a in is it that was for on are as with his they at be this from i have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see could no make than first been its who my over down only way use may very after words just where most know you he me our any also before should am because until while against between through during again further once here why both few such own same too off under did does doing being must might shall us those whom whose every nobody nothing something somebody never always still yet since without within whatever neither nor either even much around",
    "de": "der die das und ist in zu den mit von für auf nicht ein eine einen dem des sich als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn ich ihr wir muss kann soll danach gestern etwa ob weil sonst wieder leider diese dabei mir warum oft uns bitte ihre was wo wann",
    "fr": "le la les de des du et est en un une que qui dans pour pas au aux sur par ce cette il elle nous vous je ne se sont plus avec son sa ses mais ou où être été avoir a ont comme si leur tout faut doit avant après parce autres ensuite hier soir encore dernière mieux vaut fois très même cet d l n m s c j comment pourquoi quand quoi désolé répondre",
    "es": "el la los las de del y es en un una que se no por con para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros fue ser está si ayer todavía después eso hago qué dónde cuándo cómo hacer debo queda creo empezar quedan buena mejor mi correo pasa",
    "it": "il lo la i gli le di del della dei e è in un una che non si per con come più ma sono anche da al alla nel nella questo questa ci se suo sua ho ha hanno era poi ancora secondo me stato ieri sera bisogna viene dopo prima dove quando perché cosa ogni tutto molto fare mio mia resta restano buona volta passo così posso mi dispiace dal sul",
    "pt": "o a os as de do da dos das e é em um uma que não se por com para na no ao mais mas como foi está são também já ou seu sua quando muito nos eu isso pela pelo até ser depois ainda ontem você",
    "nl": "de het een en is van in te dat op met voor niet zijn aan er ook als maar bij door naar uit dan nog wel om werd wordt deze dit die we je ik wat hoe waar moet kan gisteren",
}
#: Names of languages as prompts write them.
NAMES = {
    "en": "english englisch anglais inglés inglese английск 英語", "de": "german deutsch allemand alemán tedesco немецк ドイツ語", "fr": "french französisch français francés francese французск フランス語",
    "es": "spanish spanisch espagnol español spagnolo испанск スペイン語", "it": "italian italienisch italien italiano итальянск イタリア語", "ru": "russian russisch russe ruso russo русск ロシア語", "ja": "japanese japanisch japonais japonés giapponese японск 日本語",
    "pt": "portuguese portugiesisch portugais portugués portoghese португальск ポルトガル語", "nl": "dutch niederländisch néerlandais neerlandés olandese нидерландск オランダ語", "zh": "chinese chinesisch chinois chino cinese китайск 中国語", "ko": "korean koreanisch coréen coreano корейск 韓国語",
}
#: Scripts that tell the language (or a group of languages) by themselves.
SCRIPTS = (("ja", r"[\p{Hiragana}\p{Katakana}]"), ("ko", r"\p{Hangul}"), ("zh", r"\p{Han}"), ("ru", r"\p{Cyrillic}"), ("he", r"\p{Hebrew}"), ("ar", r"\p{Arabic}"), ("el", r"\p{Greek}"), ("hi", r"\p{Devanagari}"), ("th", r"\p{Thai}"))
_LISTS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_OWNERS = Counter(w for ws in _LISTS.values() for w in ws)
_WEIGHT = {w: [(k, 1 / _OWNERS[w] ** 2) for k, ws in _LISTS.items() if w in ws] for w in _OWNERS}
_SCRIPTS = [(k, regex.compile(p)) for k, p in SCRIPTS]
_WORD = regex.compile(r"(?<![\p{L}\p{M}\p{N}_/+=])[\p{L}\p{M}]+(?![\p{L}\p{M}\p{N}_/+=])")
_LETTER = regex.compile(r"\p{L}")
_LATIN = regex.compile(r"\p{Latin}")
_MARKS = {"de": "äöüß", "fr": "éèêàçùâîôëïœ", "es": "ñ¿¡áíóú", "it": "èòàùì", "pt": "ãõçáâê"}


#: ASCII characters that end a word become blanks; those that spoil one stay.
_ASCII_WORDS = {i: " " for i in range(128) if not (chr(i).isalnum() or chr(i) in "_/+=")}


def words(text: str) -> list[str]:
    """The whole words of a text in small letters; runs with digits, slashes and the like in them aren't words."""
    if text.isascii():
        return [w for w in text.lower().translate(_ASCII_WORDS).split() if w.isalpha()]
    return [w.lower() for w in _WORD.findall(text)]


def function_words(lang: str) -> frozenset[str]:
    return _LISTS.get(lang, frozenset())


def language(text: str, found: list[str] | None = None) -> str:
    """A language code, '' where nothing tells: no letters, or Latin letters without function words.

    found: the text's words, if the caller has them already.
    """
    plain = text.isascii()
    if not plain:
        letters = len(_LETTER.findall(text))
        if not letters:
            return ""
        if len(_LATIN.findall(text)) * 2 < letters:
            counts = {k: len(p.findall(text)) for k, p in _SCRIPTS}
            if counts["ja"] * 10 >= letters:
                return "ja"
            best = max(counts, key=counts.get)
            return best if counts[best] else ""
    found = words(text) if found is None else found
    told = [w for w in found if w in _WEIGHT]
    if not told or len(told) * 12 < len(found):
        return ""
    score: dict[str, float] = {}
    for w in told:
        for k, v in _WEIGHT[w]:
            score[k] = score.get(k, 0.0) + v
    if not plain:
        low = text.lower()
        for k, marks in _MARKS.items():
            if k in score:
                score[k] += 0.2 * sum(low.count(c) for c in marks)
    ranked = sorted(score.values(), reverse=True)
    if ranked[0] < 0.5 or (len(ranked) > 1 and ranked[0] == ranked[1]):
        return ""
    return max(score, key=score.get)


_STEMS = {name: k for k, names in NAMES.items() for name in names.split()}
_ANY_STEM = "|".join(regex.escape(n) for n in sorted(_STEMS, key=len, reverse=True))
_ASKS = regex.compile(rf"\b(?:in|into|auf|en|in das|ins|на|по)[ -](?P<a>{_ANY_STEM})|(?P<b>{_ANY_STEM})[でに]|по-(?P<c>{_ANY_STEM})")
_VERBS = regex.compile(r"\b(?:answer|reply|respond|write|translate|say|antworte|antworten|schreib|übersetze|réponds|répondez|écris|écrivez|traduis|responde|contesta|escribe|traduce|rispondi|scrivi|traduci|ответь|напиши|переведи)\w*|答え|書い|訳し")


def asked_language(prompt: str) -> str:
    """The language that a prompt asks to be answered in, '' where it asks for none."""
    low = prompt.lower()
    found = _ASKS.search(low)
    return _STEMS[next(g for g in found.groups() if g)] if found and _VERBS.search(low) else ""
