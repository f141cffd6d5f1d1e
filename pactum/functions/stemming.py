"""English suffix stripping (the public Snowball English rules) and stop words, as column expressions.

A word's stem is worked out in steps, each bound once, so the expression stays small. It is meant for the distinct words of a
corpus, not for each of their occurrences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the public English search configuration.
STOP = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as
until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split()
# Words with a stem of their own, and words that stay or stay after the first step.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
KEPT = "sky news howe atlas cosmos bias andes".split()
ENDS_EARLY = "inning outing canning herring earring proceed exceed succeed".split()
# Suffixes of the second, third and fourth step, and what takes their place.
SECOND = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()

_REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
_SHORT_END = "(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def _bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once however often f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _less(w: Column, n: int | Column, add: str | Column = "") -> Column:
    """w without its last n letters, and add behind it."""
    n = F.lit(n) if isinstance(n, int) else n
    kept = F.substring(w, F.lit(1), F.length(w) - n)
    return kept if isinstance(add, str) and add == "" else F.concat(kept, F.lit(add) if isinstance(add, str) else add)


def _suffix(w: Column, suffixes) -> Column:
    """The longest of the suffixes that w ends in, or nothing."""
    return F.regexp_extract(w, f"(?:{'|'.join(suffixes)})$", 0)


def _swap(w: Column, s: Column, values: dict[str, str]) -> Column:
    added = F.lit("")
    for old, new in values.items():
        added = F.when(s == old, F.lit(new)).otherwise(added)
    return _less(w, F.length(s), added)


def _first(w: Column) -> Column:
    """Plural endings."""
    return (
        F.when(w.rlike("sses$"), _less(w, 2))
        .when(w.rlike("(?:ied|ies)$"), F.when(F.length(w) > 4, _less(w, 2)).otherwise(_less(w, 1)))
        .when(w.rlike("(?:us|ss)$"), w)
        .when(w.rlike("[aeiouy].+s$"), _less(w, 1))
        .otherwise(w)
    )


def _past(w: Column, r1: Column) -> Column:
    """Endings of past and running forms."""

    def mended(x: Column) -> Column:
        return F.when(x.rlike("(?:at|bl|iz)$"), F.concat(x, F.lit("e"))).when(x.rlike("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), _less(x, 1)).when((F.length(x) <= r1) & x.rlike(_SHORT_END), F.concat(x, F.lit("e"))).otherwise(x)

    def by(s: Column) -> Column:
        eed = s.isin("eed", "eedly")
        return F.when(eed, F.when(F.length(w) - F.length(s) >= r1, _less(w, F.length(s), "ee")).otherwise(w)).when((s != "") & _less(w, F.length(s)).rlike("[aeiouy]"), _bind(_less(w, F.length(s)), mended)).otherwise(w)

    return _bind(_suffix(w, ("eedly", "eed", "edly", "ed", "ingly", "ing")), by)


def _second(w: Column, r1: Column) -> Column:
    def by(s: Column) -> Column:
        left = _less(w, F.length(s))
        holds = (s != "") & (F.length(left) >= r1) & ((s != "ogi") | left.rlike("l$")) & ((s != "li") | left.rlike("[cdeghkmnrt]$"))
        return F.when(holds, _swap(w, s, SECOND)).otherwise(w)

    return _bind(_suffix(w, SECOND), by)


def _third(w: Column, r1: Column, r2: Column) -> Column:
    def by(s: Column) -> Column:
        at = F.length(w) - F.length(s)
        return F.when((s != "") & (at >= r1) & ((s != "ative") | (at >= r2)), _swap(w, s, THIRD)).otherwise(w)

    return _bind(_suffix(w, THIRD), by)


def _fourth(w: Column, r2: Column) -> Column:
    def by(s: Column) -> Column:
        left = _less(w, F.length(s))
        return F.when((s != "") & (F.length(left) >= r2) & ((s != "ion") | left.rlike("[st]$")), left).otherwise(w)

    return _bind(_suffix(w, FOURTH), by)


def _last(w: Column, r1: Column, r2: Column) -> Column:
    at = F.length(w) - 1
    silent = w.endswith("e") & ((at >= r2) | ((at >= r1) & ~_less(w, 1).rlike(_SHORT_END)))
    return F.when(silent | (w.endswith("ll") & (at >= r2)), _less(w, 1)).otherwise(w)


def _steps(word: Column) -> Column:
    # y is a consonant, written Y, where it begins a word or follows a vowel
    marked = F.regexp_replace(F.regexp_replace(word, "^y", "Y"), "(?<=[aeiou])y", "Y")

    def regions(w: Column) -> Column:
        lead = F.when(w.rlike("^(?:gener|commun|arsen)"), F.regexp_extract(w, "^(?:gener|commun|arsen)", 0)).otherwise(F.regexp_extract(w, _REGION, 0))
        r1 = F.when(lead == "", F.length(w)).otherwise(F.length(lead))
        rest = lambda at: F.regexp_extract(F.substring(w, at + 1, F.length(w)), _REGION, 0)
        return _bind(r1, lambda a: _bind(rest(a), lambda x: _bind(F.when(x == "", F.length(w)).otherwise(a + F.length(x)), lambda b: all_steps(w, a, b))))

    def all_steps(w: Column, r1: Column, r2: Column) -> Column:
        early = lambda x: F.when(x.isin(ENDS_EARLY), x).otherwise(later(x))
        ended = lambda x: F.regexp_replace(x, "(?<=.[^aeiouy])[yY]$", "i")
        later = lambda x: _bind(_past(x, r1), lambda c: _bind(ended(c), lambda d: _bind(_second(d, r1), lambda e: _bind(_third(e, r1, r2), lambda f: _bind(_fourth(f, r2), lambda g: _last(g, r1, r2))))))
        return _bind(_first(w), early)

    return F.lower(_bind(marked, regions))


def english_stem(word: Column) -> Column:
    """The stem of a lower-case word of letters and digits; words of one or two letters are their own."""
    fixed = F.create_map(*[F.lit(x) for pair in (OWN | {w: w for w in KEPT}).items() for x in pair])
    return F.when(F.length(word) <= 2, word).otherwise(F.coalesce(F.element_at(fixed, word), _steps(word)))


def is_stop_word(word: Column) -> Column:
    return word.isin(STOP)
