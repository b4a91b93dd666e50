"""The queries of this subpackage and their SQL."""

from bundlewright.llm import chat, language_id, media, near_duplicates, packing, quality_rules, repeats, sharding, token_counts, transducer

MODULES = (chat, language_id, media, packing, sharding, repeats, quality_rules, token_counts, transducer, near_duplicates)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
