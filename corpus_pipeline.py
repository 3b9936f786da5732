"""From raw documents to packed sequences: each stage is an operator of pagefold.llm, written and read again before the next."""

from pagefold.llm.common import materialize
from pagefold.llm.decontaminate import decontamination_stage
from pagefold.llm.lines import line_stage
from pagefold.llm.packing import packing_stage
from pagefold.llm.quality import quality_stage
from pagefold.llm.simhash import simhash_stage

STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier and the tokenizer can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages in turn over the documents; each result but the last goes through a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}")
    return docs
