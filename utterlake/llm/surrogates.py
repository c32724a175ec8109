"""PII: keyed, type-consistent surrogates.

Names are found after a title or several, and then wherever the same word stands in the document; each word of a name has a surrogate
of its own, so "Mr. John Smith", "Mr. Smith" and "Smith" stay one person. It is made of syllables of its script: a given name
of the title's gender (else of its ending's), or a family name. Names in scripts without a table of syllables, and all other
entities, are permuted in their format: signs within their own alphabet, by a keyed permutation of all strings of that
format, so one format's entities keep apart by construction. Digits, Latin, accented Latin, Greek, Cyrillic and Devanagari
have alphabets of their own, all other letters and digits those of their script in Unicode. Marks, case and layout stay; a
card keeps its first digit and a right check digit, an address on a network whether it is public, a mail host is the same
for all its users, a date is a date. One entity has one surrogate in the whole corpus, however it is written. Surrogates
that equal an entity of the corpus, or each other across formats, are found by a join over all distinct entities and drawn
anew until there are none; every TIGHT draws the format grows by a sign or syllable, so there is always a free one. Dates
and house numbers are too few to keep from being some other person's.
"""

from __future__ import annotations

import ipaddress
import re
import secrets
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, lru_cache
from hashlib import blake2b
from math import ceil, log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterlake.runtime import discard, materialize, table

ROUNDS = 8
#: Draws in a format before it grows by a sign.
TIGHT = 8
#: Up to so many entities with a later draw go to the workers with the code; more are joined to the texts.
BROADCAST_REDRAWN = 100_000
KEY_CONF = "spark.utterlake.surrogate.key"
_TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Mme": "f", "Madame": "f", "Señora": "f", "Dr": "", "Prof": ""}
#: Signs that go with the letter before, as vowels do in many scripts.
_SIGNS_OF_LETTERS = "".join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.category(c) in ("Mn", "Mc"))
_LETTER = rf"(?:[^\W\d_]|[{_SIGNS_OF_LETTERS}])"
_WORD = rf"[^\W\d_a-z]{_LETTER}*(?:[-'’](?![sS]\b){_LETTER}+)*"
_STREETS = r"Street|Avenue|Road|Lane|Drive|Boulevard|Court|Square"
_ROADS = r"straße|strasse|gasse|allee|platz|weg|str\."
_BEFORE_STREETS = r"(?:rue|avenue|boulevard|place|calle|avenida|plaza|via) (?:(?:de|la|le|les|du|des|del|los|las) |d['’]|l['’])*"
#: A title as listed, in capitals, or, with its dot, in small letters; degrees and more titles may follow it.
_TITLE = "|".join([*_TITLES, *(t.upper() for t in _TITLES), *(rf"{t}(?=\.)" for t in ("mr", "mrs", "ms", "dr", "prof"))])
_DEGREES = r"med|phil|jur|rer|nat|pol|oec|habil|Ing|Dipl|h\. ?c"
#: Months by language.
_MONTHS = {
    "en": "January February March April May June July August September October November December".split(), "short": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(), "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
_MONTH = "|".join(sorted({m for of in _MONTHS.values() for m in of}, key=len, reverse=True))
_BORN = r"(?:\b(?=[BbDdGgNn])(?:[Bb]orn(?: on)?|DOB|[Dd]ate of birth|[Gg]eboren(?: am)?|[Nn]ée? le|[Nn]acid[oa] el):? )"
_ENTITY = re.compile(
    r"(?P<email>[\w+-][\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w+])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?P<secret>\b(?=[\w-]*\d)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})\b|\b(?:sk|pk|ghp|AKIA)[-_A-Za-z0-9]{16,}\b)"
    rf"|{_BORN}(?:(?:the )?(?P<born>\d{{1,2}}(?:st|nd|rd|th|er|\.)? (?:of |de )?(?:{_MONTH})\.?,? (?:de |del )?\d{{4}}|(?:{_MONTH})\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}})(?!\w)"
    r"|(?P<birth>\d{4}[./-]\d{1,2}[./-]\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{4})(?!\w))"
    r"|(?:\b(?:[Pp]assport|Reisepass|[Pp]asseport|[Pp]asaporte)(?: (?:no|number|nr|numéro|número))?[.:#]? ?)(?P<passport>[A-Z]{0,2}\d{6,9})(?!\w)"
    r"|(?:\b(?=[TtPpFfMmCc])(?:[Tt]el|[Pp]hone|[Tt]elefon|[Tt]éléphone|[Tt]eléfono|[Ff]ax|[Mm]obile?|[Cc]all)\.?:? )(?P<national>\(?0\d{1,5}\)?(?:[ ./-]?\d{2,5}){1,4})(?![\w-])"
    rf"|(?P<house>(?<![\w.-])\d{{1,5}}),? (?P<street>{_WORD}(?: {_WORD})?)(?= (?:{_STREETS})\b)"
    rf"|(?P<number>(?<![\w.-])\d{{1,5}}),? {_BEFORE_STREETS}(?P<rue>{_WORD}(?: {_WORD})?)"
    rf"|(?:\b(?=[DFHMPSdmp])(?P<title>(?:{_TITLE})(?:\.? (?:{_TITLE}|{_DEGREES})\b)*)\.? (?:[^\W\d_]\. ?)*)(?P<name>{_WORD}(?: {_WORD}){{0,2}})"
)
#: Every entity but these holds a digit or an @: names follow a title, and some secrets start like this.
_SIGNS, _TITLED = re.compile(r"[@\d]"), tuple(f"{t}{end}" for x in _TITLES for t in (x, x.upper(), *([x.lower()] if x in ("Mr", "Mrs", "Ms", "Dr", "Prof") else [])) for end in (" ", "."))
_IP6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
_ROAD = re.compile(rf"(?P<road>[^\W\d_a-z]{_LETTER}{{2,}}?)(?:{_ROADS}) (?P<plate>\d{{1,4}})(?!\w)")
_ROAD_ENDS = tuple(_ROADS.replace("\\", "").split("|"))
#: Names that are plain words too: at the start of a sentence, alone, they are taken for the word.
_PLAIN_WORDS = frozenset("will may mark bill read rose grant hope grace art frank rich young long white brown black green june april august rob sue pat drew chase faith joy dawn summer king price".split())
_LETTERS_ONLY = ("sk", "pk", "ghp", "AKIA")
_DIGITS_AND_MARKS = ("phone", "national", "ssn", "card", "iban")
_NAMES = ("given_f", "given_m", "given", "family")
#: What kinds are shown as, and those that are kept apart together: a name's surrogate is no other name's, of any kind.
_SHOWN = dict.fromkeys(_NAMES, "name") | {"house": "address", "born": "birth", "national": "phone", "ip6": "ip"}
_UNCHECKED = ("birth", "born", "house")
#: Scripts written without blanks between words.
_UNSPACED = ("CJK", "HIRAGANA", "KATAKANA", "THAI", "LAO", "KHMER", "MYANMAR", "TIBETAN")
#: Alphabets that a sign is shifted within; letters and digits of none of them have those of _others().
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह")
_HEX = "0123456789abcdef"
_OF = {c: a for a in _ALPHABETS for c in a}
#: By script: beginnings, middles, and endings of given names (f, m) and of family names (f, m).
_SYLLABLES = {
    "LATIN": (
        "al an bel ber cor da del ed el fer gar hel is jo jul kar la leo lor mar mel mi nor ol pa ram ros sal sel ta ter val vi wil".split(),
        "bi de di do ga ka la le li lo ma mi na ne no ra ri ro sa se si ta ti va vi".split(),
        {"given_f": "na ra la ia sa ta line nette rina della".split(), "given_m": "do ric mon bert lan nard ton vin rius lek".split(), "family": "berg ford ham land ley man mer nell sen son stein ton ville well wood worth".split()},
    ),
    "CYRILLIC": (
        "ал бор вас гор дан ев зар ив кол лев мар мил ник ол пет ром сав тим фед юр".split(),
        "бо ва ди ко ла ли ме ни ра ри се та".split(),
        {"given_f": "на ра ия лина вета сия".split(), "given_m": "слав мир дан рий тин".split(), "family": "енко ский ович ук ин ов".split(), "family_f": "ова ина ская ева".split()},
    ),
    "GREEK": (
        "αλ αν βασ γε δη ελ ευ θε ιω κων λε μαρ νικ παν στε φιλ χρι".split(),
        "γε δα κο λα λι μα νι ρα ρο σι τα".split(),
        {"given_f": "α ία να ρία λένη".split(), "given_m": "ος ης ας ιος νδρος".split(), "family": "όπουλος ίδης άκης άδης ιάδης".split()},
    ),
    "DEVANAGARI": (
        "अ आ क ग ज त द न प ब म र ल व स ह".split(),
        "जि ति नि मि या रा रि ला वि शि सु".split(),
        {"given_f": "ता ना नी या ली मा".split(), "given_m": "न श त ज र व".split(), "family": "कर दास नाथ पाल राव वाल सेन".split()},
    ),
    "CJK": (
        "王 李 张 刘 陈 杨 赵 黄 周 吴 徐 孙 胡 朱 高 林 何 郭 马 罗".split(),
        "文 志 建 国 明 春 玉 海 永 新 家 子 天 光 金".split(),
        {"given_f": "芳 娜 敏 静 丽 燕 梅 兰".split(), "given_m": "伟 强 军 勇 杰 涛 平 刚".split(), "family": "山 田 村 川 华 生 林 成".split()},
    ),
    "HANGUL": (
        "김 이 박 최 정 강 조 윤 장 임 한 오 서 신 권 황".split(),
        "민 서 지 현 수 준 예 도 하 은 태 성".split(),
        {"given_f": "희 영 미 숙 아 연 진".split(), "given_m": "호 철 우 혁 훈 석 환".split(), "family": "민 석 준 현 원 규 빈".split()},
    ),
    "ARABIC": (
        "أحـ سعـ كر جا فا سل خا را ها نو يا عما".replace("ـ", "").split(),
        "ري سي لا نا با دا ما وا".split(),
        {"given_f": "مة رة لى نة ية دة".split(), "given_m": "مد يد يم بر دي مان لد شد".split(), "family": "اوي اني وري يني اسي ادي".split()},
    ),
    "HEBREW": (
        "אב דו יו נת שמ אל גב מי רא טל נו עמ".split(),
        "רי לי נא דו מי שא בי".split(),
        {"given_f": "לה נה ית רה יה".split(), "given_m": "אל ון יד ור רם".split(), "family": "וביץ ברג שטין מן זון סקי".split()},
    ),
}


@cache
def _others() -> dict[str, str]:
    """Each letter and digit outside _ALPHABETS: all of its script, kind and case, by Unicode's names for them."""
    groups = defaultdict(list)
    for c in map(chr, range(128, sys.maxunicode + 1)):
        if c.isalnum() and _lower(c) == c and c not in _OF:
            cased = len(c.upper()) == 1 and c.upper() != c and _lower(c.upper()) == c
            script = " ".join(unicodedata.name(c, "").split()[:2])
            groups[unicodedata.category(c), cased, script, c <= "\uffff", unicodedata.normalize("NFKC", c) == c].append(c)
    pooled = defaultdict(list)  # a sign that is the only one of its kind goes with the others of its category, or of all
    for (category, cased, *script), own in groups.items():
        pooled[(category, cased, *script) if len(own) > 1 else (category, cased)] += own
    alone = [k for k, own in pooled.items() if len(own) == 1]
    if alone:
        rest = [c for k in alone for c in pooled.pop(k)]
        pooled["rest"] = rest if len(rest) > 1 else [*rest, *pooled.pop(next(iter(pooled)))]
    return {c: a for a in map("".join, pooled.values()) for c in a}


def _alphabet(c: str) -> str:
    return _OF.get(c) or (c if c.isascii() else _others().get(c, c))


def _lower(value: str) -> str:
    """value in lower case, sign by sign, so that its length stays."""
    return value.lower() if value.isascii() else "".join(c.lower()[0] for c in value)


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def canonical(kind: str, value: str) -> str:
    """What one entity has in common however it is written."""
    if kind in _DIGITS_AND_MARKS:
        return "".join(c for c in _lower(value) if c.isalnum())
    if kind in ("ip", "birth"):
        return re.sub(r"\d+", lambda m: str(int(m[0])), value)
    if kind == "born":
        day, year = sorted(map(int, re.findall(r"\d+", value)))
        return f"{year}-{_month(value)[1] + 1}-{day}"
    return ipaddress.IPv6Address(value).exploded if kind == "ip6" else _lower(value)


def _month(value: str) -> tuple[str, int, str]:
    """(language, place, name as it is written) of the month in a date in words."""
    name = re.search(_MONTH, value)[0]
    return next((of, names.index(name), name) for of, names in _MONTHS.items() if name in names)


def iban_digits(entity: str) -> str:
    """The two check digits of a lower-case IBAN, whatever stands in their place."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in entity[4:] + entity[:2] + '00')) % 97:02}"


def _address6(key: bytes, entity: str, attempt: int) -> str:
    """The first group says what the address is for, and stays."""
    digits = list(entity.replace(":", "")[4:])
    new = entity[:4] + "".join(_shifted(key, ("ip6", attempt), digits, [_HEX] * len(digits)))
    return ":".join(new[i : i + 4] for i in range(0, 32, 4))


@lru_cache(100_000)
def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0]


def _table(kind: str, entity: str) -> tuple | None:
    """The syllables that a name is made of; none where its script has no table."""
    return _SYLLABLES.get(_script(entity[0])) if kind in _NAMES and entity else None


def _digest(key: bytes, *parts: object) -> bytes:
    return blake2b(repr(parts).encode(), key=key, digest_size=64).digest()


def _permuted(key: bytes, tweak: object, values: list[int], radices: list[int]) -> list[int]:
    """One half of the places is shifted by a keyed hash of the other, in turn: every step can be undone, so it is a permutation."""
    values = list(values)
    for turn in range(ROUNDS):
        own, other = (range(turn % 2, len(values), 2), range(1 - turn % 2, len(values), 2))
        seen, drawn = [values[i] for i in other], b""
        for n, i in enumerate(own):
            if 8 * n >= len(drawn):
                drawn += _digest(key, tweak, radices, turn, n, seen)
            values[i] = (values[i] + int.from_bytes(drawn[8 * n : 8 * n + 8], "little")) % radices[i]
    return values


def _shifted(key: bytes, tweak: object, entity: list, alphabets: list) -> list:
    """Each sign as another of its alphabet."""
    got = _permuted(key, (tweak, tuple(len(a) for a in alphabets)), [a.index(c) for a, c in zip(alphabets, entity, strict=True)], [len(a) for a in alphabets])
    return [a[v] for a, v in zip(alphabets, got, strict=True)]


#: First parts of public addresses; the others keep theirs, and private ones the parts that make them so.
_PUBLIC = [x for x in range(1, 224) if x not in (10, 127, 169, 172, 192)]


def _address(key: bytes, entity: str, attempt: int) -> str:
    parts = [int(x) for x in entity.split(".")]
    kept = 0 if parts[0] in _PUBLIC or attempt >= TIGHT else 2 if parts[0] in (169, 172, 192) else 1
    if parts[0] not in _PUBLIC and not kept:
        parts[0] = _PUBLIC[parts[0] % len(_PUBLIC)]
    octets = [[x] if i < kept else _PUBLIC if i == 0 else range(256) for i, x in enumerate(parts)]
    return ".".join(map(str, _shifted(key, ("ip", attempt), parts, octets)))


def _date(key: bytes, entity: str, attempt: int) -> str:
    """A year from 1930 to 2009 stays in that range; a day above 28 stays."""
    marks, parts = re.findall(r"\D", entity), [int(x) for x in re.findall(r"\d+", entity)]
    year = 0 if parts[0] > 31 else 2
    month = 1 if year == 0 or parts[0] > 12 or parts[1] <= 12 else 0
    ranges = [range(1930, 2010) if i == year else range(1, 13) if i == month else range(1, 29) for i in range(3)]
    new = _shifted(key, ("birth", attempt), parts, [r if x in r else [x] for x, r in zip(parts, ranges, strict=True)])
    return f"{new[0]}{marks[0]}{new[1]}{marks[1]}{new[2]}"


def _named(key: bytes, kind: str, entity: str, attempt: int, level: int) -> str:
    """A name of beginning, level + attempt // TIGHT middles and an ending."""
    first, middle, ends = _table(kind, entity)
    female = kind == "given_f" or (kind in ("given", "family") and entity[-1] in "aаяαάाी")
    last = ends["family_f" if kind == "family" and female and "family_f" in ends else kind if kind != "given" else "given_f" if female else "given_m"]
    parts = [first, *[middle] * (level + attempt // TIGHT), last]
    drawn = b"".join(_digest(key, kind, entity, attempt, i) for i in range(0, len(parts), 16))
    return "".join(of[int.from_bytes(drawn[4 * i : 4 * i + 4], "little") % len(of)] for i, of in enumerate(parts))


def name_level(names: int) -> int:
    """Middles that make 64 times as many names as there are to replace, in the smallest table."""
    first, middle, last = (min(len(x) for x in of) for of in zip(*((t[0], t[1], min(t[2].values(), key=len)) for t in _SYLLABLES.values()), strict=True))
    return max(0, ceil(log(max(1, 64 * names / (first * last))) / log(middle)))


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0, level: int = 0) -> str:
    """entity: canonical. The result is canonical too, and attempt // TIGHT signs (or syllables) longer, but for dates and network addresses."""
    if kind in ("ip", "ip6", "birth", "born", "house"):
        made = {"ip": _address, "ip6": _address6, "birth": _date, "born": _date, "house": lambda k, e, a: _kept(k, kind, e, a, ())}[kind](key, entity, attempt)
        return surrogate(key, kind, entity, attempt + 1) if made == entity and attempt < TIGHT else made
    if _table(kind, entity):
        return _named(key, kind, entity, attempt, level)
    if kind == "email":
        local, host = entity.split("@")
        name, dot, top = host.rpartition(".")
        return f"{_kept(key, host, local, attempt, ())}@{_kept(key, 'host', name, 0, ())}{dot}{top}"
    fixed: set[int] = set()
    if kind == "card":
        fixed = {0, len(entity) - 1}
    elif kind == "phone":  # the country's code, and the exchange 555 that stands for no line
        fixed = {*range(max(0, len(entity) - 10)), *(range(len(entity) - 7, len(entity) - 4) if entity[-7:-4] == "555" else ())}
    elif kind == "national":
        fixed = {0}
    elif kind == "iban":  # the country stays, the check digits follow from the account
        out = _kept(key, kind, entity, attempt, {0, 1, 2, 3})
        return out[:2] + iban_digits(out) + out[4:]
    elif kind == "secret":  # what says whose key it is
        fixed = set(range(next((len(p) for p in map(str.lower, _LETTERS_ONLY) if entity.startswith(p)), 0)))
    out = _kept(key, kind, entity, attempt, fixed)
    return next(out[:-1] + d for d in _alphabet(entity[-1]) if luhn(out[:-1] + d)) if kind == "card" else out


def _kept(key: bytes, tweak: str, entity: str, attempt: int, fixed: set[int] | tuple) -> str:
    """entity permuted but for the fixed places, and attempt // TIGHT signs longer."""
    hexadecimal = tweak == "secret" and not set(entity) - set(_HEX)
    alphabets = [_HEX if hexadecimal else _alphabet(c) for c in entity]
    own = next((a for a in reversed(alphabets) if len(a) > 1), _ALPHABETS[0])
    alphabets = [c if i in fixed else a for i, (c, a) in enumerate(zip(entity, alphabets, strict=True))]
    at, more = max(0, len(entity) - 1), attempt // TIGHT
    alphabets[at:at], entity = [own] * more, entity[:at] + own[0] * more + entity[at:]
    return "".join(_shifted(key, (tweak, attempt), list(entity), alphabets))


def _laid_out(kind: str, value: str, new: str) -> str:
    """new, canonical, in the layout and case of value."""
    if kind in ("ip", "birth"):
        found = re.findall(r"\d+", value)
        zero = lambda x: chr(ord(x[0]) - unicodedata.digit(x[0]))
        parts = iter([(x if x else "") for x in re.findall(r"\d+", new)])
        padded = (next(parts).zfill(len(x) if x[0] == zero(x) else 1).translate({48 + d: ord(zero(x)) + d for d in range(10)}) for x in found)
        return re.sub(r"\d+", lambda m: next(padded), value)
    if kind == "born":
        year, month, day = new.split("-")
        own, _, name = _month(value)
        named = _MONTHS[own][int(month) - 1]
        old_day, old_year = sorted(re.findall(r"\d+", value), key=int)
        return re.sub(rf"\d+|{_MONTH}", lambda m: {old_year: year, old_day: day.zfill(len(old_day)) if old_day[0] == "0" else day}.get(m[0], named if m[0] == name else m[0]), value)
    if kind == "ip6":
        made = ipaddress.IPv6Address(new)
        text = str(made) if "::" in value else ":".join(f"{int(x, 16):x}" for x in made.exploded.split(":"))
        return text.upper() if value.isupper() else text
    cased = lambda c, n: n.upper() if c.isupper() and len(n.upper()) == 1 else n
    if _table(kind, canonical(kind, value)):
        capital = "".join(x.upper() if len(x.upper()) == 1 else x for x in new)
        return capital if value.isupper() and len(value) > 1 else cased(value[0], new[0]) + new[1:]
    entity = canonical(kind, value)
    at, more = (entity.index("@") if kind == "email" else len(entity)) - 1, len(new) - len(entity)
    added, signs = new[at : at + more], iter(enumerate(new[:at] + new[at + more :]))
    out = []
    for c in value:
        i, n = next(signs) if kind not in _DIGITS_AND_MARKS or c.isalnum() else (-1, c)
        out += [*(cased(value, x) for x in added if i == at), cased(c, n)]
    return "".join(out)


def _mentions(words: dict[str, str]) -> re.Pattern:
    """Each word as it was found after a title, in capitals or with a capital, standing alone where its script has blanks."""
    forms = sorted({f for w in words for f in (w, w.upper(), w[0] + _lower(w[1:]))}, key=len, reverse=True)
    edge = lambda f, at, rule: rule if not _script(f[at]).startswith(_UNSPACED) else ""
    return re.compile("|".join(edge(f, 0, r"(?<![\w-])") + re.escape(f) + edge(f, -1, rf"(?![\w{_SIGNS_OF_LETTERS}])") for f in forms))


def _plain(text: str, m: re.Match) -> bool:
    """Whether a mention is rather the plain word that it also is: it begins a sentence, with no name after it."""
    if _lower(m[0]) not in _PLAIN_WORDS or m[0].isupper():
        return False
    before, after = text[max(0, m.start() - 3) : m.start()].rstrip(), text[m.end() : m.end() + 2]
    return (not before or before[-1] in ".!?:\"“”\n") and not (after[:1] == " " and after[1:].isupper())


def _is_address(value: str) -> bool:
    try:
        return any(c.isdigit() for c in value) and ipaddress.IPv6Address(value) is not None
    except ValueError:
        return False


def _words(m: re.Match, group: str) -> Iterator[tuple[str, int, int]]:
    start = m.start(group)
    for word in re.finditer(r"\S+", m[group]):
        if word[0][0].islower() and word[0][0].title() != word[0][0]:
            return
        yield word[0], start + word.start(), start + word.end()


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each entity, in order; a name is one for each of its words."""
    if not text or not (_SIGNS.search(text) or any(t in text for t in _TITLED) or any(x in text for x in _LETTERS_ONLY) or "::" in text):
        return []
    found: list[tuple[int, int, str]] = [(*m.span(), "ip6") for m in _IP6.finditer(text) if _is_address(m[0])] if text.count(":") > 1 else []
    names: dict[str, str] = {}
    if any(x in text for x in _ROAD_ENDS):
        for m in _ROAD.finditer(text):
            found += [(*m.span("road"), "family"), (*m.span("plate"), "house")]
    wide = list(found)
    for m in _ENTITY.finditer(text):
        kind = m.lastgroup
        if any(a < m.end() and m.start() < b for a, b, _ in wide):
            continue
        if kind == "name":
            words = list(_words(m, "name"))
            gender = next((g for t in re.findall(r"\w+", m["title"]) if (g := _TITLES.get(t.capitalize()))), "")
            for i, (word, start, end) in enumerate(words):
                own = "family" if i == len(words) - 1 else f"given_{gender}" if gender else "given"
                found.append((start, end, names.setdefault(_lower(word), own)))
        elif kind in ("street", "rue"):
            number, street = {"street": ("house", "street"), "rue": ("number", "rue")}[kind]
            found.append((*m.span(number), "house"))
            found += [(start, end, "family") for _, start, end in _words(m, street)]
        elif not (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) and not (kind == "card" and not luhn(canonical("card", m[0]))):
            found.append((*m.span(kind), kind))
    if names:
        taken = sorted(found)
        spans, at = [], 0
        for m in _mentions(dict.fromkeys(text[s:e] for s, e, k in taken if k in _NAMES and _lower(text[s:e]) in names)).finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if (at == len(taken) or taken[at][0] >= m.end()) and not _plain(text, m):
                spans.append((*m.span(), names[_lower(m[0])]))
        found += spans
    return [(kind, start, end) for start, end, kind in sorted(found)]


@lru_cache(100_000)
def _first(key: bytes, kind: str, entity: str, level: int) -> str:
    return surrogate(key, kind, entity, 0, level)


def replaced(text: str, key: bytes, known: dict[tuple[str, str], int], level: int = 0) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds replaced. known: attempts of the entities whose first surrogate collides."""
    out, at, kinds = [], 0, []
    for kind, start, end in find(text):
        entity = canonical(kind, text[start:end])
        attempt = known.get((kind, entity), 0)
        new = surrogate(key, kind, entity, attempt, level) if attempt else _first(key, kind, entity, level)
        out += [text[at:start], _laid_out(kind, text[start:end], new)]
        at = end
        kinds.append(_SHOWN.get(kind, kind))
    return "".join([*out, text[at:]]), kinds


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = {(o, k, canonical(k, t[s:e])) for o, t in zip(b.column("_of").to_pylist(), b.column("text").to_pylist(), strict=True) for k, s, e in find(t)}
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["_of", "kind", "entity"])


def _together(kind: str) -> Column:
    return F.when(F.col(kind).isin(*_NAMES), "name").otherwise(F.col(kind))


def attempts(entities: DataFrame, key: bytes, level: int = 0) -> DataFrame:
    """(kind, entity, attempt) of the entities whose first surrogate equals an entity or another's surrogate; attempt is one that does not.

    Only the entities whose draw collides are drawn again. Each TIGHT draws give them strings of a new length, of which the
    finite corpus can hold but some, so the number of those left comes to none. Network addresses cannot grow: after
    8 * TIGHT draws, which only a corpus with most of them needs, the last one stands.
    """
    tasks = max(8, int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(key, *x, level) for x in zip(*(b.column(c).to_pylist() for c in ("kind", "entity", "attempt")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("entity"), b.column("attempt"), pa.array(new, pa.string())], names=["kind", "entity", "attempt", "new"])

    schema = "kind string, entity string, attempt int, new string"
    checked = entities.where(~F.col("kind").isin(*_UNCHECKED))
    drawn = materialize(checked.withColumn("attempt", F.lit(0)).repartition(tasks).mapInArrow(draw, schema), "surrogates")
    taken = checked.select(_together("kind").alias("_as"), F.col("entity").alias("new")).distinct().withColumn("real", F.lit(True))
    while True:
        ranked = drawn.withColumn("_as", _together("kind")).withColumn("_turn", F.row_number().over(Window.partitionBy("_as", "new").orderBy("attempt", "entity", "kind")))
        judged = ranked.join(taken, ["_as", "new"], "left").select("kind", "entity", "attempt", "new", ((F.col("real").isNotNull() | (F.col("_turn") > 1)) & ~((F.col("kind") == "ip") & (F.col("attempt") >= 8 * TIGHT))).alias("bad"))
        judged = materialize(judged, "judged")
        discard(drawn)
        if judged.where("bad").isEmpty():
            return judged.where("attempt > 0").select("kind", "entity", "attempt")
        again = judged.where("bad").select("kind", "entity", (F.col("attempt") + 1).alias("attempt")).repartition(tasks).mapInArrow(draw, schema)
        drawn = materialize(judged.where("NOT bad").select("kind", "entity", "attempt", "new").union(again), "surrogates")
        discard(judged)


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per input row: doc_id, text with surrogates, n_entities, kinds (sorted, distinct, comma-joined).

    key: 1 to 64 secret bytes; whoever has it can tell which surrogate an entity has. A null text stays null and an empty
    one empty, with no entities. Repeated rows each give a row with the same surrogates; null ids stay null; other columns
    are ignored; an empty table gives an empty result.
    """
    if not 0 < len(key) <= 64:
        raise ValueError("the key must have 1 to 64 bytes")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Names a text for the redrawn entities in it. Two texts with one hash only share what is looked up, not what is replaced.
    of = F.xxhash64("text", "doc_id").alias("_of")
    seen = materialize(rows.select(of, "text").mapInArrow(_found, "_of long, kind string, entity string"), "entities")
    distinct = materialize(seen.select("kind", "entity").distinct(), "distinct")
    level = name_level(distinct.where(F.col("kind").isin(*_NAMES)).count())
    redrawn = materialize(attempts(distinct, key, level), "redrawn")
    few = redrawn.limit(BROADCAST_REDRAWN + 1).collect()
    shipped = {(r.kind, r.entity): r.attempt for r in few} if len(few) <= BROADCAST_REDRAWN else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = (({(x["kind"], x["entity"]): x["attempt"] for x in k or ()} for k in b.column("known").to_pylist()) if shipped is None else (shipped for _ in range(b.num_rows)))
            got = [(None, []) if t is None else replaced(t, key, k, level) for t, k in zip(b.column("text").to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([t for t, _ in got], pa.string()), pa.array([len(k) for _, k in got], pa.int64()), pa.array([",".join(sorted(set(k))) for _, k in got], pa.string()),
            ], names=["doc_id", "text", "n_entities", "kinds"])

    if shipped is None:
        known = seen.join(redrawn, ["kind", "entity"]).groupBy("_of").agg(F.collect_set(F.struct("kind", "entity", "attempt")).alias("known"))
        rows = rows.select("doc_id", "text", of).join(known, "_of", "left").select("doc_id", "text", "known")
    return rows.mapInArrow(run, "doc_id long, text string, n_entities long, kinds string")


def session_key(spark: SparkSession) -> bytes:
    """The key that KEY_CONF names in hex; where it is unset, one drawn for this call alone."""
    given = spark.conf.get(KEY_CONF, None)
    return bytes.fromhex(given) if given else secrets.token_bytes(32)


QUERIES = {"op7_pii_surrogates": lambda spark, sf_dir: pseudonymise(table(spark, sf_dir, "documents"), session_key(spark))}
ORACLES: dict = {}
