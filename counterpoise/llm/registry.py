"""Queries of this package by name, with SQL where it can say the same."""

import corpus_pipeline
from counterpoise.llm import (
    decontaminate,
    licenses,
    lm,
    merkle,
    packing,
    phrases,
    quality,
    separators,
    simhash,
    spotsigs,
    suffix,
    toxicity,
    trie,
)

MODULES = (suffix, separators, lm, spotsigs, licenses, toxicity, quality, simhash, decontaminate, packing, phrases, merkle,
           trie)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
