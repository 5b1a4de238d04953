"""All queries of this subpackage and their SQL."""

from motifloom.llm import components, cooccur, languages, leaks, neardup, packing, sample, spans, topn

_ALL = (cooccur, sample, neardup, spans, components, topn, packing, leaks, languages)
QUERIES = {k: f for m in _ALL for k, f in m.QUERIES.items()}
SQL = {k: s for m in _ALL for k, s in m.SQL.items()}
