import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from tests.llm.cases import ODD, none, odd
from utterlake.llm import surrogates as s

KEY = b"k"
TEXT = 'Ask anna.b@mail7.example.com or +1 (017) 555-7713, card 4689387053447877, at 97.51.17.173, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962". Frau Maria Иванова'


def test_kinds_are_found_and_replaced_in_their_format():
    new, kinds = s.replaced(TEXT, KEY, {})
    assert kinds == ["email", "phone", "card", "ip", "secret", "name", "name"]
    for value in ("anna.b@mail7", "(017)", "4689387053447877", "97.51.17.173", "04dbebab", "Maria", "Иванова"):
        assert value not in new
    assert len(new.split()) == len(TEXT.split()) and "555" in new and "+1 (" in new
    assert re.search(r"\d{1,3}(\.\d{1,3}){3}", new) and re.search(r'token = "[0-9a-f]{40}"', new)
    first, last = new.split()[-2:]
    latin, cyrillic = s._SYLLABLES["LATIN"], s._SYLLABLES["CYRILLIC"]
    assert first.istitle() and first.lower().endswith(tuple(latin[2]["given_f"])) and last.istitle() and last.lower().endswith(tuple(cyrillic[2]["family_f"]))
    assert s.luhn(re.search(r"card (\d+)", new)[1]) and re.search(r"card (\d)", new)[1] == "4"


def test_a_number_without_its_check_digit_is_no_card():
    assert s.replaced("order 1234567812345678 stays, 4539578763621486 goes", KEY, {})[1] == ["card"]


def test_surrogates_of_one_format_keep_apart():
    for kind, entities in {"ip": [f"10.0.{i}.{j}" for i in range(40) for j in range(50)], "phone": [f"1212555{i:04}" for i in range(3000)], "email": [f"ab.{i:03}@x.org" for i in range(1000)]}.items():
        assert len({s.surrogate(KEY, kind, e) for e in entities}) == len(entities)


def test_permutations_reach_every_string_of_a_format_once():
    for alphabets in (["01", "abc"], ["012"], ["ab", "x", "0123", "01"]):
        every = list(itertools.product(*alphabets))
        assert sorted(tuple(s._shifted(KEY, "t", list(e), alphabets)) for e in every) == sorted(every)


def test_one_entity_one_surrogate_however_it_is_written():
    a, _ = s.replaced("call +1 (017) 555-7713 or +1 017 555 7713, A@X.ORG, a@x.org, b@x.org", KEY, {})
    found = re.findall(r"\+[\d ()-]+\d|\w+@\w+\.\w+", a)
    digits = [re.sub(r"\D", "", x) for x in found[:2]]
    assert digits[0] == digits[1] and found[2].lower() == found[3] and found[2].isupper()
    assert found[3].split("@")[1] == found[4].split("@")[1] != "x.org"
    assert s.luhn("4539578763621486") and s.luhn(s.surrogate(KEY, "card", "4539578763621486"))


def test_a_person_stays_one_person_in_a_document():
    new, kinds = s.replaced("Mr. John Smith spoke. Then Smith left, as Mr. Smith does; JOHN SMITH waved. Smithson and john did not. Dr. 田中 saw田中.", KEY, {})
    given, family = re.match(r"Mr\. (\w+) (\w+) spoke", new).groups()
    assert f"Then {family} left, as Mr. {family} does; {given.upper()} {family.upper()} waved. Smithson and john did not." in new
    assert given.lower().endswith(tuple(s._SYLLABLES["LATIN"][2]["given_m"])) and "田中" not in new and len(kinds) == 8
    assert re.search(r"Dr\. (\w+) saw\1\.$", new)


def test_secrets_of_letters_alone_other_digits_dates_passports_and_streets():
    text = "ghp_abcdefghijklmnopqrstuvwxyz"
    new, kinds = s.replaced(text, KEY, {})
    assert kinds == ["secret"] and new != text and new.startswith("ghp_") and len(new) == len(text)
    new, kinds = s.replaced("call +१ (०१७) ५५५-७७१३ now, host ९७.५१.१७.१७३", KEY, {})
    assert kinds == ["phone", "ip"] and re.fullmatch(r"call \+१ \([०-९]{3}\) [०-९]{3}-[०-९]{4} now, host [०-९.]+", new) and "०१७" not in new
    new, kinds = s.replaced("born on 1980-02-03, DOB: 13/04/1999; Passport no. X1234567; 12 Maple Hill Street", KEY, {})
    assert kinds == ["birth", "birth", "passport", "address", "name", "name"] and not re.search("1980-02-03|13/04/1999|X1234567|12 Maple|Hill", new)
    year, month, day = map(int, re.search(r"born on (\d{4})-(\d\d)-(\d\d)", new).groups())
    assert 1930 <= year <= 2009 and 1 <= month <= 12 and 1 <= day <= 28 and new.endswith(" Street")
    assert s.replaced("at 10.0.0.7 and 192.168.1.9", KEY, {})[0].startswith("at 10.") and "192.168." in s.replaced("at 10.0.0.7 and 192.168.1.9", KEY, {})[0]


def test_collisions_are_drawn_anew(spark):
    rows = [("ssn", f"{i:09}") for i in range(0, 4000, 7)]
    first = s.surrogate(KEY, "ssn", rows[0][1])
    entities = spark.createDataFrame([*rows, ("ssn", first)], "kind string, entity string")
    got = {r.entity: r.attempt for r in s.attempts(entities, KEY).collect()}
    assert got.get(rows[0][1], 0) > 0
    final = [s.surrogate(KEY, "ssn", e, got.get(e, 0)) for _, e in [*rows, ("ssn", first)]]
    assert len(set(final)) == len(final) and not set(final) & {e for _, e in [*rows, ("ssn", first)]}


def test_names_of_any_script_are_replaced(spark):
    names = ["王小明", "김철수", "محمد", "משה", "さくら", "สมชาย", "Ōe", "İnci", "Ńśćź", "ΓΙΩΡΓΟΣ", "Գրիգոր", "გიორგი", "𠮷野", "राहुल", "Пётр"]
    rows = spark.createDataFrame([(i, f"Then Dr. {n} left, and Dr. {n} came") for i, n in enumerate(names)], "doc_id long, text string")
    for r in s.pseudonymise(rows, KEY).collect():
        old, new = names[r.doc_id], re.fullmatch(r"Then Dr\. (\S+) left, and Dr\. (\S+) came", r.text).groups()
        assert new[0] == new[1] != old and old not in r.text and r.n_entities == 2
        assert s._script(new[0][0]) == s._script(old[0]) and new[0].isupper() == old.isupper()
        assert s._script(old[0]) in s._SYLLABLES or len(new[0]) == len(old)


def test_a_format_with_no_free_surrogate_grows(spark):
    taken = [f"Ա{chr(c)}" for c in range(0x561, 0x587)]
    rows = [(i, f"Dr. {n.capitalize()} and Mr. {n.upper()} met") for i, n in enumerate(taken)]
    every = [(90, " ".join(f"Dr. {chr(a).upper()}{chr(b)}" + "," for a in range(0x561, 0x587) for b in range(0x561, 0x587)))]
    got = {r.doc_id: re.findall(r"(?:Dr|Mr)\. (\w+)", r.text) for r in s.pseudonymise(spark.createDataFrame(rows + every, "doc_id long, text string"), KEY).collect()}
    all_names = {n.lower() for n in taken} | {m.lower() for m in re.findall(r"Dr\. (\w+)", every[0][1])}
    new = [n.lower() for n in got[90]]
    assert len(set(new)) == len(new) == len(all_names) and not set(new) & all_names and max(map(len, new)) > 2
    for kind, value in {"phone": "+1 (017) 555-7713", "ssn": "123-45-6789", "card": "4539 5787 6362 1486", "iban": "DE44 5001 0517 5407 3249 31", "email": "A.b@x.org"}.items():
        entity = s.canonical(kind, value)
        for attempt in range(4 * s.TIGHT):
            new = s.surrogate(KEY, kind, entity, attempt)
            assert len(new) == len(entity) + attempt // s.TIGHT and s.canonical(kind, s._laid_out(kind, value, new)) == new
            assert kind != "card" or s.luhn(new)


def plain_pseudonyms(texts, level):
    """All texts at once, in plain Python: entities judged against each other until none collides."""
    entities = {(k, s.canonical(k, t[a:b])) for t in texts if t for k, a, b in s.find(t)}
    group = lambda k: "name" if k in s._NAMES else k
    attempt = dict.fromkeys((e for e in entities if e[0] not in s._UNCHECKED), 0)
    real = {(group(k), e) for k, e in attempt}
    while True:
        holders = {}
        for (k, e), n in attempt.items():
            holders.setdefault((group(k), s.surrogate(KEY, k, e, n, level)), []).append((n, e, k))
        bad = [x for new, own in holders.items() for i, x in enumerate(sorted(own)) if i or new in real]
        if not bad:
            break
        for n, e, k in bad:
            attempt[k, e] = n + 1
    return [t and s.replaced(t, KEY, attempt, level)[0] for t in texts], {k: v for k, v in attempt.items() if v}


@pytest.mark.parametrize("shipped", [100_000, 0])
def test_the_operator_matches_a_plain_version(spark, monkeypatch, shipped):
    monkeypatch.setattr(s, "BROADCAST_REDRAWN", shipped)
    monkeypatch.setattr(s, "name_level", lambda n: 0)  # few names, so that they collide
    rng = random.Random(3)
    make = [
        lambda: f"{rng.choice(list(s._TITLES))} {rng.choice('abcdefgh').upper()}{rng.choice('aeiou')}{rng.choice('lmn')}{rng.choice('aeiou')} {rng.choice('KLMNP')}{rng.choice('aeiou')}{rng.choice('rst')}son",
        lambda: f"{rng.randrange(100)}.{rng.randrange(4)}.0.{rng.randrange(9)}", lambda: f"a{rng.randrange(99)}@b{rng.randrange(9)}.org", lambda: f"{rng.randrange(1000):03}-{rng.randrange(3):02}-000{rng.randrange(10)}", lambda: TEXT,
    ]
    texts = [" and ".join(rng.choice(make)() for _ in range(rng.randint(0, 6))) for _ in range(400)] + [None, ""]
    want, redrawn = plain_pseudonyms(texts, 0)
    assert len(redrawn) > 20
    rows = spark.createDataFrame([(None if i % 9 == 0 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = s.pseudonymise(rows.repartition(5), KEY).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((None if i % 9 == 0 else i // 2, t) for i, t in enumerate(want))
    news, olds = defaultdict(set), defaultdict(set)
    for old, new in zip(texts, want, strict=True):
        for (k, a, b), (_, c, d) in zip(s.find(old), s.find(new), strict=True) if old and not s._TITLES.keys() & set(re.findall(r"\w+", old)) else ():
            news[k, s.canonical(k, old[a:b])].add(s.canonical(k, new[c:d]))
            olds[k, s.canonical(k, new[c:d])].add(s.canonical(k, old[a:b]))
    assert len(news) > 100 and all(len(x) == 1 for x in [*news.values(), *olds.values()]) and not news.keys() & olds.keys()


def test_a_key_is_asked_for(spark):
    with pytest.raises(ValueError, match="key"):
        s.pseudonymise(none(spark), b"")
    assert s.session_key(spark) != s.session_key(spark)
    spark.conf.set(s.KEY_CONF, "0a0b")
    assert s.session_key(spark) == b"\n\x0b"
    spark.conf.unset(s.KEY_CONF)


def test_every_letter_and_digit_has_an_alphabet():
    import sys

    signs = {s._lower(c) for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum()}
    assert all(len(s._alphabet(c)) > 1 and c in s._alphabet(c) for c in signs)
    assert all(s._alphabet(x) == a for a in {s._alphabet(c) for c in signs} for x in a)


def test_odd_rows(spark):
    got = s.pseudonymise(odd(spark), KEY).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted((d or -1, t or "") for d, t, *_ in ODD)
    assert s.pseudonymise(none(spark), KEY).collect() == []
    two = s.pseudonymise(spark.createDataFrame([(1, TEXT), (2, "x " * 50000 + TEXT), (2, None)], "doc_id long, text string"), KEY).orderBy(F.col("text").desc_nulls_last()).collect()
    assert two[0].text.endswith(two[1].text) and two[1].n_entities == 7 and two[2].text is None
