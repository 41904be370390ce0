"""English stems as column expressions: the published Porter2 (Snowball English) rules.

Suffixes are taken off where the word allows it: R1 is what follows the first consonant after a vowel, R2 the same
within R1. A stem is meant for words of a vocabulary, not for every occurrence of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing, as the public English list has them.
STOP = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them "
    "their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did "
    "doing a an the and but if or because as until while of at by for with about against between into through during before after above "
    "below to from up down in out on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now".split()
)
# Exceptions of the rules.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
KEPT_LATER = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
# Suffixes and what takes their place, longest first, within R1 (steps 2 and 3) or R2 (step 4).
STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less",
    "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful",
    "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
V, NOT_V = "[aeiouy]", "[^aeiouy]"
DOUBLE = "(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)"


def _let(value: Column, f) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def _cut(w: Column, n: int, put: str = "") -> Column:
    return F.concat(F.substring(w, F.lit(1), F.length(w) - n), F.lit(put))


def _short(w: Column) -> Column:
    """Ends in a short syllable."""
    return w.rlike(f"(?:^|{NOT_V}){V}[^aeiouywxY]$") & w.rlike(f"(?:{NOT_V}{V}|^{V})[^aeiouywxY]$") & ~w.rlike(f"^{NOT_V}*$")


def _first(w: Column, rules: list[tuple[str, Column]]) -> Column:
    """What the rule of the first suffix that fits gives; its value may be ``w`` itself."""
    out = None
    for suffix, value in rules:
        c = w.endswith(suffix)
        out = F.when(c, value) if out is None else out.when(c, value)
    return out.otherwise(w)


def _in(w: Column, region: Column, n: int) -> Column:
    """A suffix of n letters lies in the region."""
    return F.length(w) - n >= region


def stem(word: Column) -> Column:
    """The stem of a word in lower case; words of two letters or less, and those with other letters than a to z, stay."""
    regular = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), f"({V})y", "$1Y")
    special = reduce(lambda c, kv: c.when(word == kv[0], kv[1]), IRREGULAR.items(), F.when(F.length(word) <= 2, word)).when(word.isin(*KEPT) | ~word.rlike("^[a-z]+$"), word)
    return special.otherwise(_let(regular, lambda w: _let(_region(w, F.lit(0), True), lambda r1: _let(_region(w, r1, False), lambda r2: _steps(w, r1, r2)))))


def _region(w: Column, start: Column, first: bool) -> Column:
    tail = F.substring(w, start + 1, F.length(w))
    plain = F.regexp_extract(tail, f"^{NOT_V}*{V}+{NOT_V}", 0)
    found = F.when(tail.rlike("^(?:gener|arsen)"), 5).when(tail.rlike("^commun"), 6).otherwise(F.length(plain)) if first else F.length(plain)
    return F.when(found > 0, start + found).otherwise(F.length(w))


def _steps(w: Column, r1: Column, r2: Column) -> Column:
    def step1a(w):
        ied = F.when(F.length(w) > 4, _cut(w, 2)).otherwise(_cut(w, 1))
        s = F.when(w.rlike(f"{V}.+s$"), _cut(w, 1)).otherwise(w)
        return _first(w, [("sses", _cut(w, 2)), ("ied", ied), ("ies", ied), ("us", w), ("ss", w), ("s", s)])

    def step1b(w):
        def took(n):
            x = _cut(w, n)
            mended = F.when(x.rlike("(?:at|bl|iz)$"), F.concat(x, F.lit("e"))).when(x.rlike(f"{DOUBLE}$"), _cut(x, 1)).when(_short(x) & (F.length(x) <= r1), F.concat(x, F.lit("e"))).otherwise(x)
            return F.when(x.rlike(V), mended).otherwise(w)

        ee = lambda n: F.when(_in(w, r1, n), _cut(w, n, "ee")).otherwise(w)
        return _first(w, [("eedly", ee(5)), ("ingly", took(5)), ("edly", took(4)), ("eed", ee(3)), ("ing", took(3)), ("ed", took(2))])

    def step1c(w):
        return F.when(w.rlike(f"^.+{NOT_V}[yY]$"), _cut(w, 1, "i")).otherwise(w)

    def step2(w):
        def rule(s, put):
            ok = _in(w, r1, len(s))
            if s == "li":
                ok = ok & w.rlike("[cdeghkmnrt]li$")
            if s == "ogi":
                ok = ok & w.endswith("logi")
            return s, F.when(ok, _cut(w, len(s), put)).otherwise(w)

        return _first(w, [rule(*kv) for kv in STEP2.items()])

    def step3(w):
        return _first(w, [(s, F.when(_in(w, r2 if s == "ative" else r1, len(s)), _cut(w, len(s), put)).otherwise(w)) for s, put in STEP3.items()])

    def step4(w):
        return _first(w, [(s, F.when(_in(w, r2, len(s)) & (w.rlike("[st]ion$") if s == "ion" else F.lit(True)), _cut(w, len(s))).otherwise(w)) for s in STEP4])

    def step5(w):
        before = _cut(w, 1)
        e = F.when(_in(w, r2, 1) | _in(w, r1, 1) & ~_short(before), before).otherwise(w)
        return F.when(w.endswith("e"), e).when(w.endswith("ll") & _in(w, r2, 1), before).otherwise(w)

    rest = lambda w: _let(step1b(w), lambda w: _let(step1c(w), lambda w: _let(step2(w), lambda w: _let(step3(w), lambda w: _let(step4(w), step5)))))
    return _let(step1a(w), lambda w: F.when(w.isin(*KEPT_LATER), w).otherwise(F.lower(rest(w))))
