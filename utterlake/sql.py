"""The text functions for SQL: register(spark) makes them temporary functions of the session, and chunks a table function.

    SELECT d.doc_id, c.chunk_no, c.chunk FROM documents d, LATERAL chunks(d.text) c

Functions are SQL expressions, so they are inlined and compiled as any other; each states what the Column of its name in
functions/text.py does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from utterlake.functions import text as T

_WHITE = r"[\s\x1c-\x1f]+"


def _quoted(text: str) -> str:
    return "r'" + text + "'"


def _script() -> str:
    """The block with most signs, of equal ones the block seen first; places of ASCII count in the text, as all others do."""
    votes = ", ".join(f"struct(length(t) - length(regexp_replace(t, {_quoted(f'[{block}]+')}, '')) AS n, -regexp_instr(t, {_quoted(f'[{block}]')}) AS first, '{lang}' AS lang)" for lang, block in T.SCRIPTS.items())
    return f"(SELECT if(best.n > 0, best.lang, 'en') FROM (SELECT greatest({votes}) AS best))"


def _symbols(lang: str) -> str:
    out = "t"
    for sign, word in T.SYMBOLS[lang].items():
        out = f"replace({out}, '{sign}', ' {word} ')"
    return out


#: name -> (parameters, type, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "clean": ("t STRING", "STRING", f"trim(regexp_replace(t, {_quoted('(?U)' + _WHITE)}, ' '))"),
    "script": ("t STRING", "STRING", _script()),
    "script_scheme": ("lang STRING", "STRING", "CASE " + " ".join(f"WHEN lang = '{k}' THEN '{v}'" for k, v in T.SCHEMES.items()) + " ELSE 'devanagari' END"),
    "split_sentences": ("t STRING", "ARRAY<STRING>", f"filter(transform(regexp_extract_all(t, {_quoted(f'[^{T.SENTENCE_ENDS}]*[{T.SENTENCE_ENDS}]+|[^{T.SENTENCE_ENDS}]+')}, 0), s -> regexp_replace(s, {_quoted(f'(?U)^{_WHITE}|{_WHITE}$')}, '')), s -> s <> '')"),
    "symbols_said": ("t STRING, lang STRING", "STRING", f"if(lang = 'hi', {_symbols('hi')}, {_symbols('en')})"),
    "train_prompt": ("t STRING", "STRING", "concat('<|task_tts|><|start_content|>', t, '<|end_content|>')"),
    "render_tokens": ("ids ARRAY<INT>, kind STRING", "STRING", "array_join(transform(ids, i -> concat('<|bicodec_', kind, '_', i, '|>')), '')"),
    "parse_tokens": ("t STRING, kind STRING", "ARRAY<INT>", r"transform(regexp_extract_all(t, concat(r'<\|bicodec_', kind, r'_(\d+)\|>'), 1), x -> cast(x AS INT))"),
    "hash32": ("t STRING", "BIGINT", "cast(conv(substring(md5(t), 1, 8), 16, 10) AS BIGINT)"),
    "lang_of_path": ("p STRING, root STRING", "STRING", "try_element_at(split(p, '/'), cast(nullif(array_position(split(p, '/'), root), 0) AS INT) + 1)"),
    "language_dir": ("name STRING", "BOOLEAN", "length(name) BETWEEN 2 AND 4 AND name = lower(name) AND name <> upper(name)"),
}
_SENTENCES = re.compile(f"[^{T.SENTENCE_ENDS}]*[{T.SENTENCE_ENDS}]+|[^{T.SENTENCE_ENDS}]+")


@udtf(returnType="chunk_no int, chunk string", useArrow=True)
class Chunks:
    """chunks(text [, target]): the text's sentences merged greedily, as functions.text.chunked does. Null and blank texts have none."""

    def eval(self, text: str, target: int = T.CHUNK_CHARS) -> Iterator[tuple[int, str]]:
        held, size, number = [], 0, 0
        for piece in _SENTENCES.findall(" ".join(text.split())) if text is not None else []:
            sentence = piece.strip()
            if not sentence:
                continue
            if size and size + len(sentence) > target * T.CHUNK_SLACK:
                yield number, " ".join(held)
                held, size, number = [], 0, number + 1
            held.append(sentence)
            size += len(sentence)
        if held:
            yield number, " ".join(held)


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make all of FUNCTIONS, and chunks, temporary functions with that prefix. Returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register(f"{prefix}chunks", Chunks)
    return [*(f"{prefix}{name}" for name in FUNCTIONS), f"{prefix}chunks"]
