"""All queries of the core and their SQL."""

from siftwood.plans import basics, checks, graphs, planted, proofs, searching, streams, texts, training

_MODULES = (basics, graphs, searching, checks, texts, planted, streams, training, proofs)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
