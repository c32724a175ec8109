"""What is found, against texts whose entities are known because they are put together here."""

import ipaddress
import random
import re

import pytest

from utterlake.llm import surrogates as s

KEY = b"k"


def spans(text):
    return [(k, text[a:b]) for k, a, b in s.find(text)]


@pytest.mark.parametrize(("text", "want"), [
    ("Prof. Dr. Hans Müller, Müller", [("given", "Hans"), ("family", "Müller"), ("family", "Müller")]),
    ("Dr. med. Anna Weber kam. Weber ging.", [("given", "Anna"), ("family", "Weber"), ("family", "Weber")]),
    ("Frau Prof. Dr. h. c. Eva Klein", [("given_f", "Eva"), ("family", "Klein")]),
    ("Mr. Smith's car. Smith’s dog. SMITH", [("family", "Smith"), ("family", "Smith"), ("family", "SMITH")]),
    ("Mr. Sean O'Brien met O'Brien's son", [("given_m", "Sean"), ("family", "O'Brien"), ("family", "O'Brien")]),
    ("MR. JOHN SMITH came", [("given_m", "JOHN"), ("family", "SMITH")]),
    ("dr. Jones said Jones", [("family", "Jones"), ("family", "Jones")]),
    ("Mr. Will Read. Will Read spoke. Will he? He may.", [("given_m", "Will"), ("family", "Read"), ("given_m", "Will"), ("family", "Read")]),
    ("born 1 March 1980", [("born", "1 March 1980")]), ("Born on March 1st, 1980", [("born", "March 1st, 1980")]), ("geboren am 1. März 1980", [("born", "1. März 1980")]),
    ("née le 3 mai 1975", [("born", "3 mai 1975")]), ("nacido el 1 de marzo de 1980", [("born", "1 de marzo de 1980")]), ("on 1 March 1980", []),
    ("tel 020 7946 0958", [("national", "020 7946 0958")]), ("Telefon: (030) 1234567", [("national", "(030) 1234567")]), ("item 020 7946 0958", []),
    ("at 2001:db8::ff00:42:8329 or ::1 or fe80::1.", [("ip6", "2001:db8::ff00:42:8329"), ("ip6", "::1"), ("ip6", "fe80::1")]), ("std::vector at 12:30:45, a::b", []),
    ("12, Oak Street", [("house", "12"), ("family", "Oak")]), ("Hauptstraße 12", [("family", "Haupt"), ("house", "12")]), ("Umweg drei", []), ("12 rue de la Paix", [("house", "12"), ("family", "Paix")]),
])
def test_known_texts(text, want):
    assert spans(text) == want


def test_planted_entities_are_found_and_nothing_else():
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    word = lambda: "".join(rng.choices("bdfgklmnprstv", k=1) + rng.choices("aeiou", k=1) + rng.choices("bdfgklmnprst", k=1) + ["o"])
    month = lambda of: rng.choice(s._MONTHS[of])
    make = {
        "email": lambda: ("", f"{word()}.{word()}@{word()}{digits(1)}.org"), "ip": lambda: ("", ".".join(str(rng.randrange(1, 250)) for _ in range(4))),
        "ip6": lambda: ("", str(ipaddress.IPv6Address(rng.getrandbits(128)))), "phone": lambda: ("", f"+{rng.randrange(1, 99)} {digits(3)} {digits(3)} {digits(4)}"),
        "national": lambda: ("Tel.: ", f"0{digits(3)} {digits(3)} {digits(3)}"), "ssn": lambda: ("", f"{digits(3)}-{digits(2)}-{digits(4)}"),
        "born": lambda: rng.choice([("born on ", f"{rng.randrange(1, 29)} {month('en')} {rng.randrange(1930, 2010)}"), ("geboren am ", f"{rng.randrange(1, 29)}. {month('de')} {rng.randrange(1930, 2010)}"), ("née le ", f"{rng.randrange(1, 29)} {month('fr')} {rng.randrange(1930, 2010)}")]),
        "family": lambda: (rng.choice(["Mr. ", "Dr. ", "MRS ", "Prof. Dr. ", "Herr "]), word().title()),
    }
    clean = ["the price rose by 12.5 percent", "see chapter 3", "at 10:45 we met", "version 1.2.3", "call me", "In the Street", "50 % of all", "x = a::b"]
    for _ in range(1500):
        text, want = "", []
        for _ in range(rng.randint(1, 6)):
            if rng.random() < 0.5:
                kind = rng.choice(list(make))
                before, value = make[kind]()
                want.append((kind, value))
                text += before + value
            else:
                text += rng.choice(clean)
            text += rng.choice([", ", "; ", " and ", ".\n"])
        got = spans(text)
        again = {v for k, v in want if k == "family"}  # a name that is drawn twice stands for one person
        assert [x for x in got if x in want] == want and all(x in want or x[1] in again for x in got), (text, got, want)


def test_surrogates_keep_their_type():
    rng = random.Random(2)
    for _ in range(300):
        account = "".join(rng.choices("0123456789", k=18))
        entity = f"de00{account}"
        entity = entity[:2] + s.iban_digits(entity) + entity[4:]
        for attempt in (0, s.TIGHT):
            new = s.surrogate(KEY, "iban", entity, attempt)
            assert new[:2] == "de" and new[2:4] == s.iban_digits(new) and new != entity
            assert int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1
    assert s.iban_digits("de89370400440532013000") == "89"
    for value in ("2001:db8::ff00:42:8329", "FE80::1", "1:2:3:4:5:6:7:8"):
        new, kinds = s.replaced(f"at {value}", KEY, {})
        made = ipaddress.IPv6Address(new[3:])
        assert kinds == ["ip"] and made != ipaddress.IPv6Address(value) and made.exploded[:4] == ipaddress.IPv6Address(value).exploded[:4]
    new, _ = s.replaced("geboren am 1. März 1980, born March 01, 1980", KEY, {})
    (d, m, y), (em, ed, ey) = re.match(r"geboren am (\d+)\. (\w+) (\d{4}), born (\w+) (\d\d), (\d{4})", new).groups()[:3], re.search(r"born (\w+) (\d\d), (\d{4})", new).groups()
    assert m in s._MONTHS["de"] and em in s._MONTHS["en"] and (int(d), s._MONTHS["de"].index(m), y) == (int(ed), s._MONTHS["en"].index(em), ey) and 1930 <= int(y) < 2010
    new, _ = s.replaced("Dr. 田中, Dr. 김철수, Dr. محمد, Dr. משה", KEY, {})
    assert all(s._script(w[0]) == script for w, script in zip(re.findall(r"Dr\. (\w+)", new), ("CJK", "HANGUL", "ARABIC", "HEBREW"), strict=True))


def test_mentions_of_one_entity_stay_one():
    new, _ = s.replaced("Prof. Dr. Hans Müller's book. MÜLLER and Hans left; Müller’s car. 2001:DB8::1 is 2001:db8:0:0:0:0:0:1", KEY, {})
    given, family = re.match(r"Prof\. Dr\. (\w+) (\w+)'s book", new).groups()
    assert f"{family.upper()} and {given} left; {family}’s car." in new
    a, b = (ipaddress.IPv6Address(x) for x in re.search(r"(\S+) is (\S+)$", new).groups())
    assert a == b
