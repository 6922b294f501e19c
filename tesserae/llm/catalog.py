"""Queries of this subpackage, by name."""

from __future__ import annotations

import corpus_pipeline
from tesserae.llm import chaining, chat, clustering, decontaminate, langid, media, minhash, packing, quality, repair, suffixes, toxicity, warc

MODULES = (quality, media, packing, warc, suffixes, minhash, chaining, langid, toxicity, decontaminate, clustering, chat, repair)


def queries() -> dict:
    found = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
