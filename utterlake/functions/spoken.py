"""Plug-ins of text normalisation: numbers as words, Latin words in another script. Without them texts keep digits and words.

itrans is a mapper of its own: the ITRANS spelling of Latin words, in the script of the language.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from utterlake.functions.text import INDIC_DIGITS, SCHEMES, _replace_each, clean, normalise, script
from utterlake.runtime import let

NUMBER = r"(?U)-?\d+(?:\.\d+)?"
#: Digits as signs that Unicode keeps free of meaning.
_HIDDEN = {48 + d: 0xFDD0 + d for d in range(10)}
_LATIN = re.compile(r"\b([a-zA-Z]+)\b")
_PLAIN = r"^-?[0-9]{1,15}(\.[0-9]+)?$"
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ("trillion", "billion", "million", "thousand", "")


# Hindi number words of 0 to 99, and the names of hundreds and of pairs of digits above them.
HINDI_BELOW_HUNDRED = (
    "शून्य एक दो तीन चार पाँच छह सात आठ नौ दस ग्यारह बारह तेरह चौदह पंद्रह सोलह सत्रह अठारह उन्नीस "
    "बीस इक्कीस बाईस तेईस चौबीस पच्चीस छब्बीस सत्ताईस अट्ठाईस उनतीस तीस इकतीस बत्तीस तैंतीस चौंतीस पैंतीस छत्तीस सैंतीस अड़तीस उनतालीस "
    "चालीस इकतालीस बयालीस तैंतालीस चवालीस पैंतालीस छियालीस सैंतालीस अड़तालीस उनचास पचास इक्यावन बावन तिरपन चौवन पचपन छप्पन सत्तावन अट्ठावन उनसठ "
    "साठ इकसठ बासठ तिरसठ चौंसठ पैंसठ छियासठ सड़सठ अड़सठ उनहत्तर सत्तर इकहत्तर बहत्तर तिहत्तर चौहत्तर पचहत्तर छिहत्तर सतहत्तर अठहत्तर उन्यासी "
    "अस्सी इक्यासी बयासी तिरासी चौरासी पचासी छियासी सत्तासी अट्ठासी नवासी नब्बे इक्यानवे बानवे तिरानवे चौरानवे पचानवे छियानवे सत्तानवे अट्ठानवे निन्यानवे"
).split()
HINDI_GROUPS = (("नील", 2), ("खरब", 2), ("अरब", 2), ("करोड़", 2), ("लाख", 2), ("हज़ार", 2), ("सौ", 1), ("", 2))
HINDI_MINUS, HINDI_POINT = "ऋण", "दशमलव"


def below_hundred() -> list[str]:
    """English words of 0 to 99."""
    return _ONES + [t + ("" if i == 0 else f" {_ONES[i]}") for t in _TENS for i in range(10)]


def english_number(number: Column) -> Column:
    """Words of a number in ASCII digits; one of more than 15 whole digits, or in other digits, stays as it is."""
    table = F.array(*map(F.lit, below_hundred()))

    def group(three: Column) -> Column:
        n = three.cast("int")
        hundreds, rest = F.floor(n / 100).cast("int"), n % 100
        return F.concat_ws(" ", F.when(hundreds > 0, F.concat(F.get(table, hundreds), F.lit(" hundred"))), F.when(rest > 0, F.get(table, rest)))

    def scaled(words: Column, scale: str) -> Column:
        return let(words, lambda w: F.when(w != "", F.concat(w, F.lit(f" {scale}" if scale else ""))))

    def whole(digits: Column) -> Column:
        padded = F.lpad(digits, 15, "0")
        parts = [scaled(group(F.substring(padded, 1 + 3 * i, 3)), scale) for i, scale in enumerate(SCALES)]
        words = F.concat_ws(" ", *parts)
        return let(words, lambda w: F.when(w == "", F.lit("zero")).otherwise(w))

    fraction = F.regexp_extract(number, r"\.([0-9]+)$", 1)
    spelled = F.array_join(F.transform(F.split(fraction, ""), lambda d: F.get(table, d.try_cast("int"))), " ")
    words = F.concat_ws(
        " ", F.when(F.startswith(number, F.lit("-")), F.lit("minus")), whole(F.regexp_extract(number, r"^-?([0-9]+)", 1)), F.when(fraction != "", F.concat(F.lit("point "), spelled))
    )
    return F.when(F.regexp_like(number, F.lit(_PLAIN)), words).otherwise(number)


def hindi_number(number: Column) -> Column:
    """Hindi words of a number in ASCII or Indic digits, by hundreds, thousands, lakhs, crores and so on; one of more than 15 whole digits stays as it is."""
    table = F.array(*map(F.lit, HINDI_BELOW_HUNDRED))

    def whole(digits: Column) -> Column:
        padded, at, parts = F.lpad(digits, 15, "0"), 1, []
        for name, size in HINDI_GROUPS:
            n = F.substring(padded, at, size).cast("int")
            parts.append(F.when(n > 0, F.concat(F.get(table, n), F.lit(f" {name}" if name else ""))))
            at += size
        return let(F.concat_ws(" ", *parts), lambda w: F.when(w == "", F.get(table, F.lit(0))).otherwise(w))

    def said(n: Column) -> Column:
        fraction = F.regexp_extract(n, r"\.([0-9]+)$", 1)
        spelled = F.array_join(F.transform(F.split(fraction, ""), lambda d: F.get(table, d.try_cast("int"))), " ")
        words = F.concat_ws(" ", F.when(F.startswith(n, F.lit("-")), F.lit(HINDI_MINUS)), whole(F.regexp_extract(n, r"^-?([0-9]+)", 1)), F.when(fraction != "", F.concat(F.lit(f"{HINDI_POINT} "), spelled)))
        return F.when(F.regexp_like(n, F.lit(_PLAIN)), words).otherwise(number)

    return let(F.translate(number, INDIC_DIGITS, "0123456789" * 5), said)


#: The verbalisers at hand, by language.
NUMBER_WORDS: dict[str, Callable[[Column], Column]] = {"en": english_number, "hi": hindi_number}


def verbalised(text: Column, words: Callable[[Column], Column] = english_number) -> Column:
    """Each number replaced by its words; words may be any Column function, a pandas UDF too."""
    return _replace_each(text, NUMBER, words)


# The ITRANS scheme, for Devanagari. Other scripts of India lie in blocks of the same order.
_VOWELS = dict(zip("a aa A i ii I ee u uu U oo e ai o au RRi".split(), "अ आ आ इ ई ई ई उ ऊ ऊ ऊ ए ऐ ओ औ ऋ".split(), strict=True))
_SIGNS = dict(zip("aa A i ii I ee u uu U oo e ai o au RRi".split(), "ा ा ि ी ी ी ु ू ू ू े ै ो ौ ृ".split(), strict=True)) | {"a": ""}
_CONSONANTS = dict(zip(
    "k kh g gh ~N ch Ch chh j jh ~n T Th D Dh N t th d dh n p ph b bh m y r l v w sh Sh s h x q z f L".split(),
    "क ख ग घ ङ च छ छ ज झ ञ ट ठ ड ढ ण त थ द ध न प फ ब भ म य र ल व व श ष स ह क्ष क़ ज़ फ़ ळ".split(), strict=True,
)) | {"c": "च"}
_BLOCKS = {"devanagari": 0x0900, "bengali": 0x0980, "gujarati": 0x0A80, "telugu": 0x0C00, "kannada": 0x0C80}
#: What a consonant with and without a vowel after it, and a vowel alone, become. No vowel begins as a consonant does.
_SYLLABLES = {c + v: own + sign for c, own in _CONSONANTS.items() for v, sign in [("", "्"), *_SIGNS.items()]} | _VOWELS
_SYLLABLE = re.compile(r"(?:{0})(?:\n*(?:{1}))?|(?:{1})|.".format(*("|".join(sorted(x, key=len, reverse=True)) for x in (_CONSONANTS, _VOWELS))))


def itrans(word: str, lang: str) -> str:
    """word as ITRANS in the script of lang; a consonant without a vowel after it has a virama. Letters of no sound stay."""
    out = "".join(_SYLLABLES.get(s, s) for s in (x.replace("\n", "") for x in _SYLLABLE.findall(word)))
    shift = _BLOCKS[SCHEMES.get(lang, "devanagari")] - 0x0900
    return "".join(chr(ord(c) + shift) if 0x0900 <= ord(c) < 0x0980 else c for c in out) if shift else out


def _mapped(mapper: Callable[[str, str], str], word: str, lang: str) -> str:
    """A Latin word of two letters or more as the mapper gives it, lower-cased; one that it fails on stays."""
    try:
        return mapper(word.lower(), lang) or word if len(word) > 1 else word
    except Exception:  # a word the plug-in cannot map is kept, as is one without a plug-in
        return word


def transliterated(text: Column, lang: str | Column, mapper: Callable[[str, str], str] | None = None) -> Column:
    """Latin words of two letters or more, lower-cased, as mapper(word, lang) gives them; a word that it fails on stays. No mapper: unchanged."""
    return replaced(text, F.lit(lang) if isinstance(lang, str) else lang, {}, mapper)


def replaced(text: Column, own: Column, words: dict[str | None, Callable[[Column], Column]], mapper: Callable[[str, str], str] | None) -> Column:
    """Numbers by the verbaliser of the row's language (or that of None), Latin words by the mapper: each match of the text once.

    What a verbaliser says is not read again, so its words are not transliterated.
    """
    def said(m: Column) -> Column:
        out = m
        for x, say in words.items():
            out = F.when(F.lit(True) if x is None else own == x, say(m)).otherwise(out)
        return out

    verbal = lambda t: _replace_each(t, NUMBER, said) if words else t
    if mapper is None:
        return verbal(text)

    @F.pandas_udf("string")
    def mapped(texts: pd.Series, langs: pd.Series) -> pd.Series:
        known: dict[str, dict[str, str]] = {}  # words of a batch come often

        def one(text: str, lang: str) -> str:
            parts, own = _LATIN.split(text), known.setdefault(lang, {})
            for word in set(parts[1::2]).difference(own):
                own[word] = _mapped(mapper, word, lang).translate(_HIDDEN)
            parts[1::2] = map(own.__getitem__, parts[1::2])
            return "".join(parts)

        return pd.Series([None if t is None else one(t, x) for t, x in zip(texts, langs, strict=True)], dtype=object)

    # a mapper's digits are no numbers of the text: they pass the verbaliser as signs that no text holds
    signs = "".join(map(chr, _HIDDEN.values()))
    back = lambda t: F.when(F.regexp_like(t, F.lit(f"[{signs}]")), F.translate(t, signs, "0123456789")).otherwise(t)
    return let(mapped(text, own), lambda t: let(verbal(t), back))


def processed(text: Column, lang: str | Column | None = "en", words: dict[str, Callable[[Column], Column]] | Callable[[Column], Column] | None = None, mapper: Callable[[str, str], str] | None = None) -> Column:
    """Normalised text, then numbers and Latin words by the plug-ins in one pass, then cleaning.

    lang: one language, or each row's own; null rows (None: all) are of the language of their script. words: one verbaliser
    for all, or one for each language; numbers in other languages stay digits.
    """
    own = F.lit(lang) if isinstance(lang, str) else script(text) if lang is None else F.coalesce(lang, script(text))
    says = words if isinstance(words, dict) else {None: words} if words else {}
    normal = normalise(text, lang)
    return clean(let(normal, lambda t: replaced(t, own, says, None)) if mapper is None else replaced(normal, own, says, mapper))
