"""All named queries of this subpackage and their SQL."""

from lumenfold.llm import chunks, leaks, mih, mixing, quality, quantiles, topn

_MODULES = [topn, quantiles, mih, chunks, leaks, mixing, quality]
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
