"""All queries of this subpackage and their SQL."""

from casemill.llm import exact_dedup, language_id, licences, mixing, packing, pii, quality, sharding, simhash, url_filter

_MODULES = (url_filter, sharding, quality, packing, pii, language_id, exact_dedup, simhash, mixing, licences)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
