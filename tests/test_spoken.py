import random

import pytest
from pyspark.sql import functions as F

from utterlake.functions import spoken


def column(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.y for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def plain_hindi(text):
    n = text.translate(str.maketrans("०१२३४५६७८९", "0123456789"))
    sign, n = ("ऋण ", n[1:]) if n[0] == "-" else ("", n)
    whole, _, fraction = n.partition(".")
    words, value = spoken.HINDI_BELOW_HUNDRED, int(whole)
    steps = [(10**13, "नील"), (10**11, "खरब"), (10**9, "अरब"), (10**7, "करोड़"), (10**5, "लाख"), (10**3, "हज़ार"), (100, "सौ")]
    out = []
    for size, name in steps:
        if value >= size:
            out.append(f"{words[value // size]} {name}")
            value %= size
    if value or not out:
        out.append(words[value])
    return sign + " ".join(out) + (" दशमलव " + " ".join(words[int(d)] for d in fraction) if fraction else "")


def test_hindi_numbers(spark):
    assert len(spoken.HINDI_BELOW_HUNDRED) == len(set(spoken.HINDI_BELOW_HUNDRED)) == 100
    known = {"0": "शून्य", "21": "इक्कीस", "100": "एक सौ", "1500": "एक हज़ार पाँच सौ", "250000": "दो लाख पचास हज़ार", "12345678": "एक करोड़ तेईस लाख पैंतालीस हज़ार छह सौ अठहत्तर", "-3.05": "ऋण तीन दशमलव शून्य पाँच", "१२": "बारह", "००७": "सात"}
    assert column(spark, list(known), spoken.hindi_number) == list(known.values())
    rng = random.Random(1)
    numbers = [str(rng.randrange(10 ** rng.randint(1, 15))) + rng.choice(["", "", f".{rng.randrange(1000)}"]) for _ in range(400)]
    assert column(spark, numbers, spoken.hindi_number) == [plain_hindi(n) for n in numbers]
    assert column(spark, ["1234567890123456", None], spoken.hindi_number) == ["1234567890123456", None]


def test_each_match_is_replaced_once(spark):
    """The words of a number are not transliterated, the letters of a mapped word are not read as numbers."""
    both = lambda words, mapper, lang="hi": lambda t: spoken.processed(t, lang, words, mapper)
    latin = spoken.itrans("apples", "hi")
    assert column(spark, ["5 apples", None, "", "apples", "-7"], both(spoken.english_number, spoken.itrans)) == [f"five {latin}", None, "", latin, "minus seven"]
    assert column(spark, ["5 apples 12"], both(spoken.hindi_number, lambda w, lang: f"{len(w)}{lang}")) == ["पाँच 6hi बारह"]
    assert column(spark, ["5apples a x9 9x b7c"], both(spoken.english_number, lambda w, lang: "!")) == ["fiveapples a xnine ninex bsevenc"]


def test_mappers_that_fail_leave_the_word(spark):
    def mapper(word, lang):
        if word == "bad":
            raise ValueError
        return None if word == "none" else word[::-1]

    assert column(spark, ["Bad None word 3 I"], lambda t: spoken.processed(t, "hi", spoken.hindi_number, mapper)) == ["Bad None drow तीन I"]


def test_each_row_in_its_own_language(spark):
    rows = spark.createDataFrame([(0, "has 21", "en"), (1, "has 21", "hi"), (2, "has 21", "de"), (3, "२१ है", None), (4, "has 21", None)], "i int, x string, lang string")
    out = spoken.processed(F.col("x"), F.col("lang"), spoken.NUMBER_WORDS, spoken.itrans)
    has = spoken.itrans("has", "hi")
    assert [r.y for r in rows.select("i", out.alias("y")).orderBy("i").collect()] == [f"{has} twenty one", f"{has} इक्कीस", f"{has} 21", "इक्कीस है", f"{has} twenty one"]


@pytest.mark.parametrize("mapper", [None, spoken.itrans])
def test_without_verbalisers_numbers_stay(spark, mapper):
    assert column(spark, ["7 ok"], lambda t: spoken.processed(t, "hi", None, mapper)) == [f"7 {mapper('ok', 'hi') if mapper else 'ok'}"]


def test_words_are_mapped_by_syllables():
    """One step a syllable, where there were two and more: as the letters one after the other."""
    assert [spoken.itrans(w, "hi") for w in ("kSha", "RRiShi", "k\nh", "k\na", "aik1u", "~Nxx", "é")] == ["क्ष", "ऋषि", "क्ह्", "क", "ऐक्1उ", "ङ्क्ष्क्ष्", "é"]
    assert len(spoken._SYLLABLE.findall("namaste")) == 4
    assert all(spoken._SYLLABLES[c + v] == own + sign for c, own in spoken._CONSONANTS.items() for v, sign in spoken._SIGNS.items())
