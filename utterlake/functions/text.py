"""Text functions as Columns: cleaning, script detection, normalisation, sentences, chunks, prompts and token strings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from utterlake.runtime import let

# The results depend on exactly these.
SCRIPTS = {"en": r"\x{0000}-\x{007F}", "hi": r"\x{0900}-\x{097F}", "bn": r"\x{0980}-\x{09FF}", "gu": r"\x{0A80}-\x{0AFF}", "te": r"\x{0C00}-\x{0C7F}", "kn": r"\x{0C80}-\x{0CFF}"}
SYMBOLS = {
    "en": {"%": "percent", "&": "and", "+": "plus", "=": "equals", "@": "at", "/": "slash"},
    "hi": {"%": "pratishat", "&": "aur", "+": "jama", "=": "barabar", "@": "at", "/": "bata"},
}
CURRENCIES = {"$": {"en": "dollar", "hi": "dollar"}, "€": {"en": "euro", "hi": "euro"}, "£": {"en": "pound", "hi": "pound"}, "₹": {"en": "rupee", "hi": "rupaye"}}
SCHEMES = {"hi": "devanagari", "mr": "devanagari", "sa": "devanagari", "bn": "bengali", "gu": "gujarati", "te": "telugu", "kn": "kannada"}
SENTENCE_ENDS = "।॥?!."
CHUNK_CHARS, CHUNK_SLACK, LONG_TEXT = 300, 1.2, 300
CHUNK_BLOCK = 256

INDIC_DIGITS = "".join(chr(start + d) for start in (0x0966, 0x09E6, 0x0AE6, 0x0C66, 0x0CE6) for d in range(10))
#: What (?U)[\s\x1c-\x1f] matches, for trims.
_BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_ACRONYM, _CURRENCY = r"(?U)\b[A-Z][A-Z0-9&]+\b", r"(?U)[$£€₹]\s?\d+(?:\.\d+)?"


def clean(text: Column) -> Column:
    """White space runs become one blank, the ends are stripped; \\x1c to \\x1f count as white space."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def script(text: Column) -> Column:
    """The language whose block holds most characters; the block seen first wins a tie; none: en."""
    # ASCII is cut out in long runs, and only what is left is searched for the other blocks. A block's place there, r, lies
    # before the first ASCII sign, at e in the text, where r < e: 2 r and 2 e - 1 compare as the places in the text do.
    ascii_block, *others = SCRIPTS.values()
    langs = list(SCRIPTS)

    def best_of(rest: Column) -> Column:
        votes = [F.struct((F.length(text) - F.length(rest)).alias("n"), (1 - 2 * F.regexp_instr(text, F.lit(f"[{ascii_block}]"))).alias("first"), F.lit(langs[0]).alias("lang"))]
        for lang, block in zip(langs[1:], others, strict=True):
            n = F.length(rest) - F.length(F.regexp_replace(rest, f"[{block}]+", ""))
            votes.append(F.struct(n.alias("n"), (-2 * F.regexp_instr(rest, F.lit(f"[{block}]"))).alias("first"), F.lit(lang).alias("lang")))
        return F.greatest(*votes)

    best = let(F.regexp_replace(text, f"[{ascii_block}]+", ""), best_of)
    return F.when(best["n"] > 0, best["lang"]).otherwise(F.lit("en"))


def scheme(lang: Column) -> Column:
    """Name of the script that a language is transliterated into."""
    return F.coalesce(*(F.when(lang == k, F.lit(v)) for k, v in SCHEMES.items()), F.lit("devanagari"))


def _replace_each(text: Column, pattern: str, new) -> Column:
    """text with each match m of pattern replaced by new(m)."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pieces = F.zip_with(between, found, lambda b, m: F.concat(b, F.coalesce(new(m), F.lit(""))))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.array_join(pieces, "")).otherwise(text)


def space_acronyms(text: Column) -> Column:
    return _replace_each(text, _ACRONYM, lambda m: F.array_join(F.split(m, ""), " "))


def expand_currency(text: Column, lang: str = "en") -> Column:
    """A symbol and amount become amount and name; English names take an s above one."""
    own = lang if lang in ("en", "hi") else "en"

    def words(m: Column) -> Column:
        amount = F.regexp_extract(m, r"(?U)\d+(?:\.\d+)?", 0)
        name = F.coalesce(*(F.when(F.startswith(m, F.lit(s)), F.lit(names[own])) for s, names in CURRENCIES.items()))
        plural = F.translate(amount, INDIC_DIGITS, "0123456789" * 5).try_cast("double") > 1
        return F.concat(amount, F.lit(" "), name, F.when(plural & F.lit(own == "en"), F.lit("s")).otherwise(F.lit("")))

    return _replace_each(text, _CURRENCY, words)


def replace_symbols(text: Column, lang: str = "en") -> Column:
    for sign, word in SYMBOLS.get(lang, SYMBOLS["en"]).items():
        text = F.replace(text, F.lit(sign), F.lit(f" {word} "))
    return text


def by_language(text: Column, lang: str | Column | None, of) -> Column:
    """of(text, language) with each row's own language; where it is null, or None is given, the text's script says which.

    of is called with the languages that have tables of their own; all others are treated as English.
    """
    if isinstance(lang, str):
        return of(text, lang)
    own = script(text) if lang is None else F.coalesce(lang, script(text))
    first, *others = SYMBOLS
    cases = F.when(own == others[0], of(text, others[0]))
    for x in others[1:]:
        cases = cases.when(own == x, of(text, x))
    return cases.otherwise(of(text, first))


def normalise(text: Column, lang: str | Column | None = "en") -> Column:
    """Acronyms, then currency, then symbols, then cleaning, in a language or each row's own (by_language); numbers stay digits where no verbaliser is plugged in."""
    return by_language(text, lang, _normalised)


def _normalised(text: Column, lang: str) -> Column:
    return clean(let(space_acronyms(text), lambda a: let(expand_currency(a, lang), lambda c: replace_symbols(c, lang))))


def sentences(text: Column) -> Column:
    """Cut after each run of sentence ends; ends stay, pieces are stripped, blank ones go."""
    # Cut by one split that takes the white space behind an end along: each match of regexp_extract_all costs many times as much.
    pieces = F.split(F.btrim(text, F.lit(_BLANKS)), rf"(?U)(?<=[{SENTENCE_ENDS}])(?![{SENTENCE_ENDS}])[\s\x1c-\x1f]*", -1)
    return F.array_remove(pieces, F.lit(""))


def chunks(parts: Column, target: int = CHUNK_CHARS) -> Column:
    """Sentences merged greedily up to target * CHUNK_SLACK characters, blanks between them not counted; none is split."""
    most = F.lit(target * CHUNK_SLACK)
    none = F.array().cast("array<string>")
    start = lambda open_, n: F.struct(none.alias("done"), open_.alias("open"), n.alias("n"))

    def add(acc: Column, s: Column) -> Column:
        full = (acc["n"] > 0) & (acc["n"] + F.length(s) > most)
        merged = F.when(acc["n"] == 0, s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        cut = F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), s.alias("open"), F.length(s).alias("n"))
        return F.when(full, cut).otherwise(F.struct(acc["done"].alias("done"), merged.alias("open"), (acc["n"] + F.length(s)).alias("n")))

    # an append copies what is done, so blocks of sentences are folded by themselves and their chunks joined: n * sqrt(n), not n * n
    def block(acc: Column, i: Column) -> Column:
        inner = F.aggregate(F.slice(parts, i * CHUNK_BLOCK + 1, F.lit(CHUNK_BLOCK)), start(acc["open"], acc["n"]), add)
        return let(inner, lambda own: F.struct(F.concat(acc["done"], own["done"]).alias("done"), own["open"].alias("open"), own["n"].alias("n")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK_BLOCK).cast("int"))
    folded = F.aggregate(blocks, start(F.lit(""), F.lit(0)), block, lambda acc: F.when(acc["n"] > 0, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))
    return F.when(F.size(parts) > 0, folded).when(parts.isNotNull(), none)


def chunked(text: Column, target: int = CHUNK_CHARS) -> Column:
    return let(sentences(clean(text)), lambda parts: chunks(parts, target))


def normalised_chunks(text: Column, lang: str | Column | None = None, target: int = CHUNK_CHARS) -> Column:
    """Normalised in the language (the script's where it is null), then cut into chunks."""
    return let(normalise(text, lang), lambda t: chunked(t, target))


def train_prompt(text: Column) -> Column:
    """What a model is given to read; its loss is masked."""
    return F.concat(F.lit("<|task_tts|><|start_content|>"), text, F.lit("<|end_content|>"))


def train_completion(global_tokens: Column, semantic_tokens: Column) -> Column:
    """What it learns to say after train_prompt."""
    return F.concat(F.lit("<|start_global_token|>"), global_tokens, F.lit("<|end_global_token|><|start_semantic_token|>"), semantic_tokens, F.lit("<|end_semantic_token|><|im_end|>"))


def inference_prompt(text: Column, global_tokens: Column) -> Column:
    """A prompt that holds the voice already and is open for semantic tokens."""
    return F.concat(train_prompt(text), F.lit("<|start_global_token|>"), global_tokens, F.lit("<|end_global_token|><|start_semantic_token|>"))


def bitmap(words: list[int]) -> Column:
    """Packed bits, 64 a word, as a constant of the plan."""
    return F.expr(f"array({', '.join(f'{w}L' if w > -(1 << 63) else 'bigint(-9223372036854775808)' for w in words)})") if words else F.array().cast("array<bigint>")


def packed(ids: Iterable[int]) -> list[int]:
    """The words of a bitmap in which the bits of ids are set."""
    words: dict[int, int] = {}
    for i in ids:
        words[i >> 6] = words.get(i >> 6, 0) | 1 << (i & 63)
    return [w - (1 << 64) if w >> 63 else w for w in (words.get(k, 0) for k in range(max(words, default=-1) + 1))]


def allowed_scores(scores: Column, allowed: Column | Iterable[int]) -> Column:
    """scores where the bit of their place is set in allowed, minus infinity elsewhere: one bit test a score however many ids are allowed.

    allowed: a bitmap (bitmap, corpus.allowed_ids), or ids. Places beyond the bitmap are not allowed; null scores stay null where they are.
    """
    bits = allowed if isinstance(allowed, Column) else bitmap(packed(allowed))

    def masked(x: Column, i: Column) -> Column:
        word = F.get(bits, F.shiftright(i, 6))
        return F.when(word.isNotNull() & (F.getbit(F.coalesce(word, F.lit(0).cast("bigint")), i.bitwiseAND(F.lit(63))) == 1), x.cast("double")).otherwise(F.lit(float("-inf")))

    return F.transform(scores, masked)


def language_dir(name: Column) -> Column:
    """Two to four signs, lower case, with a letter that has case."""
    return F.length(name).between(2, 4) & (name == F.lower(name)) & (name != F.upper(name))


def render_tokens(ids: Column, kind: str) -> Column:
    return F.array_join(F.transform(ids, lambda i: F.concat(F.lit(f"<|bicodec_{kind}_"), i.cast("string"), F.lit("|>"))), "")


def parse_tokens(text: Column, kind: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(rf"<\|bicodec_{kind}_(\d+)\|>"), F.lit(1)), lambda x: x.cast("int"))


def fingerprint(*parts: Column) -> Column:
    """First 12 hex digits of the md5 of the parts joined by colons."""
    return F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12)


def hash32(text: Column) -> Column:
    """First 32 bits of the md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def lang_of_path(path: Column, root: str) -> Column:
    """The path's element after the first that equals root; null where there is none."""
    parts = F.split(path, "/")
    return F.try_element_at(parts, F.nullif(F.array_position(parts, F.lit(root)), F.lit(0).cast("bigint")).cast("int") + 1)
