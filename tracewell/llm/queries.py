"""All training-data queries by name."""

from __future__ import annotations

import corpus_pipeline
from tracewell.llm import (  # noqa: F401  they register themselves
    chat_queries,
    decontaminate_queries,
    jaccard_queries,
    language_queries,
    lexical_queries,
    licenses_queries,
    line_dedup_queries,
    packing_queries,
    quality_queries,
    registry,
    resharding_queries,
    substring_dedup_queries,
    warc_queries,
    whitening_queries,
)


def queries() -> dict[str, registry.Query]:
    return registry.QUERIES | {"pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    more = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return registry.ORACLES | more
