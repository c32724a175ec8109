"""The queries of this subpackage and the SQL that states the same results, where SQL can."""

from utterlake.llm import bpe, conversations, exact_dedup, licences, mixing, pieces, quality, simhash, surrogates, syncmers, token_files, toxicity, vector_codes

_MODULES = (bpe, quality, simhash, syncmers, exact_dedup, mixing, surrogates, toxicity, token_files, licences, conversations, pieces, vector_codes)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
