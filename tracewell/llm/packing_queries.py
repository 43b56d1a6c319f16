"""op4: every document tokenised and packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import packing, tables
from tracewell.llm.registry import query

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    return str(public_tokenizers.path(TOKENIZER))


@query("op4_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, tokenizer_path())
