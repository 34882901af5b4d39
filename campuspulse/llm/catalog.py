"""Queries and SQL twins of the text operators."""

from __future__ import annotations

import corpus_pipeline
from campuspulse.llm import (
    bpe, chat_format, decontaminate, exact_dedup, fill_in_middle, jaccard_join, license_scan, line_dedup, pii, quality_crf, secret_crf, span_dedup,
    whitening,
)

MODULES = (exact_dedup, quality_crf, pii, span_dedup, bpe, jaccard_join, line_dedup, chat_format, license_scan, decontaminate,
           whitening, secret_crf, fill_in_middle)


def queries():
    found = {}
    for module in MODULES:
        found |= module.QUERIES
    return found | {"pipeline": corpus_pipeline.run}


def oracles():
    found = {}
    for module in MODULES:
        found |= module.ORACLES
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
