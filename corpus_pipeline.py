"""The corpus pipeline: quality rules, near-duplicates, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
`run` writes each stage's result as Parquet in the shared folder and reads it
again, so a lost executor costs part of one stage. All but the last return
the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontamination, packing, pii, quality_rules, simhash
from quern.llm.common import persisted, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the quality rules reject go."""
    judged = quality_rules.judge(docs.withColumns({f"__{c}": F.col(f"`{c}`") for c in docs.columns}))
    return judged.where("kept").select([F.col(f"`__{c}`").alias(c) for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of near-duplicates the document with the smallest id stays."""
    return simhash.deduplicate(docs).select(*docs.columns)


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: contaminated documents go."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: personal data in the text becomes pseudonyms; n_chars follows the text where the table has it."""
    out = pii.replace(docs, pii.session_key(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the pieces of the training sequences, with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality_rules", keep_good),
    ("simhash", keep_one_of_each),
    ("decontamination", keep_clean_of_benchmark),
    ("pii", pseudonymised),
    ("packing", packed),
]

#: SimHash components, Feistel permutations and packing are not expressible; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = persisted(stage(spark, docs, sf_dir))
    return docs
