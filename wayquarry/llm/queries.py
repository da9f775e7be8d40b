"""All queries of this subpackage and the SQL of those that SQL can express."""

from . import queries_corpus, queries_forms, queries_models, queries_text

MODULES = (queries_text, queries_corpus, queries_models, queries_forms)
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in MODULES for name, q in m.ORACLE_SQL.items()}
