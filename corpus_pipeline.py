"""A training corpus from raw documents: filter, deduplicate, decontaminate, tokenise.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every
stage's result as Parquet to the shared folder and reads it back as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pactline.llm._spark import shared_folder, table
from pactline.llm.decontamination import without_benchmark
from pactline.llm.line_dedup import without_line_copies
from pactline.llm.minhash_dedup import keep_one_of_each_group
from pactline.llm.sentencepiece_codec import with_token_counts
from pactline.llm.toxicity import without_toxic

STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_line_copies),
    ("minhash_near_dedup", keep_one_of_each_group),
    ("decontamination", without_benchmark),
    ("sentencepiece", with_token_counts),
]

#: training a classifier and merging symbol pairs cannot be written in SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
