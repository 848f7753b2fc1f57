"""Suffix stripping in steps, by the measure of what is left, as column expressions.

The published five-step algorithm for English, with the extensions in common use: a list of irregular
words, short words left alone, "ies" and "ied" of four-letter words, "alli" and "fulli".
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from reportloom.functions.helpers import ColumnOrName, as_col, let

# Irregular words, and the endings of steps two to four with what takes their place.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)

# A run of consonants and a run of vowels; y is a vowel behind a consonant. A first y is written Y meanwhile.
CONSONANTS, VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
HAS_VOWEL = "[aeiou]|.y"
MEASURE_1 = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}"  # one change from vowel to consonant, or more
MEASURE_2 = MEASURE_1 + VOWELS + CONSONANTS
ONLY_1 = f"{MEASURE_1}(?:{VOWELS})?$"
SHORT = f"^(?:{CONSONANTS}[aeiouy][^aeiouwxyY]|[aeiou][^aeiou])$"


def _without(word: Column, n: int) -> Column:
    return F.left(word, F.length(word) - n)


def _replaced(endings: Mapping[str, str]):
    """The longest listed ending is replaced if what stands before it has a measure of one."""
    split = f"(?s)^(.*?)({'|'.join(endings)})$"
    places = F.create_map(*[F.lit(v) for pair in endings.items() for v in pair])

    def step(word: Column) -> Column:
        head, ending = F.regexp_extract(word, split, 1), F.regexp_extract(word, split, 2)
        return F.when((ending != "") & head.rlike(MEASURE_1), F.concat(head, F.try_element_at(places, ending))).otherwise(word)

    return step


def _plural(word: Column) -> Column:
    return (
        F.when((F.length(word) == 4) & word.endswith("ies"), _without(word, 1))
        .when(word.rlike("(?:ss|i)es$"), _without(word, 2))
        .when(word.rlike("[^s]s$"), _without(word, 1)).otherwise(word)
    )


def _tidy(head: Column) -> Column:
    """What is left of a participle gets its e back, or loses a doubled consonant."""
    return (
        F.when(head.rlike("(?:at|bl|iz)$"), F.concat(head, F.lit("e")))
        .when(head.rlike(r"([^aeiouylsz])\1$"), _without(head, 1))
        .when(head.rlike(SHORT), F.concat(head, F.lit("e"))).otherwise(head)
    )


def _participle(word: Column) -> Column:
    head = F.regexp_extract(word, "(?s)^(.*)(?:ed|ing)$", 1)
    return (
        F.when(word.endswith("ied"), F.when(F.length(word) == 4, _without(word, 1)).otherwise(_without(word, 2)))
        .when(word.endswith("eed"), F.when(_without(word, 3).rlike(MEASURE_1), _without(word, 1)).otherwise(word))
        .when(head.rlike(f"(?s){HAS_VOWEL}"), let(head, _tidy)).otherwise(word)
    )


def _last_y(word: Column) -> Column:
    return F.regexp_replace(word, "(?s)^(.+[^aeiouy])y$", "$1i")


def _adverb(word: Column) -> Column:
    """Adverbs of adjectives in "al", which go through the second step as these."""
    return F.when(word.endswith("alli") & _without(word, 4).rlike(MEASURE_1), _without(word, 2)).otherwise(word)


def _logic(word: Column) -> Column:
    return F.when(word.endswith("logi") & _without(word, 3).rlike(MEASURE_1), _without(word, 1)).otherwise(word)


def _dropped(word: Column) -> Column:
    head = F.regexp_extract(word, f"(?s)^(.*?)({'|'.join(STEP_4)}|(?<=[st])ion)$", 1)
    return F.when(head.rlike(MEASURE_2), head).otherwise(word)


def _last_e(word: Column) -> Column:
    return F.when(word.endswith("e"), let(_without(word, 1), lambda head: F.when(
        head.rlike(MEASURE_2) | (head.rlike(ONLY_1) & ~head.rlike(SHORT)), head
    ).otherwise(word))).otherwise(word)


def _last_l(word: Column) -> Column:
    return F.when(word.endswith("ll") & _without(word, 1).rlike(MEASURE_2), _without(word, 1)).otherwise(word)


def stem(value: ColumnOrName) -> Column:
    """Lower-case stem; a phrase is treated as one word, so its end is stemmed. NULL stays NULL."""
    steps = (
        _plural, _participle, _last_y, _adverb, _replaced(STEP_2), _logic, _replaced(STEP_3), _dropped, _last_e, _last_l,
    )
    word = F.lower(as_col(value))
    irregular = F.create_map(*[F.lit(v) for pair in IRREGULAR.items() for v in pair])
    out = F.regexp_replace(word, "^y", "Y")
    for step in steps:
        out = let(out, step)  # bound once a step, so that the expression stays small
    return F.coalesce(F.try_element_at(irregular, word), F.when(F.length(word) <= 2, word).otherwise(F.lower(out)))
