"""The corpus pipeline: quality rules, toxicity, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with their
columns; the last gives the pieces of packed sequences. run() writes each stage's rows to
the shared folder and reads them again as the next one's input, so a lost executor costs
one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabulith.llm import line_dedup, packing, quality, simhash, toxicity
from tabulith.llm.common import documents, written

STAGES = [
    ("quality rules", quality.stage),
    ("toxicity", toxicity.stage),
    ("line dedup", line_dedup.stage),
    ("simhash near-dedup", simhash.stage),
    ("packing", packing.stage),
]

#: The boosted trees, the language models, the fingerprints and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
