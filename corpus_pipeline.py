"""The documents of a training corpus, cleaned and mixed: each stage takes what the one before it kept.

``run`` writes every stage's documents as Parquet to the folder that the cluster shares, and reads them again. The result has
the whole documents: their columns as cleaned and masked, then what the mix takes of them.

Defined results: null and empty texts are clean, apart and of size 0, so they pass all stages; of equal rows one stays; an
empty table gives no rows; other columns, whatever their names, go along. A missing benchmark item, label or secret is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language_id, mixing, near_dedup, secrets_scan
from tessera.llm import toxicity as weak
from tessera.llm.common import materialize, read_table

#: Hundredths of similarity that link near duplicates here; operator 3's own contract links at 85.
SIMILAR = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Labels are learnt only from documents outside the held-out fold."""
    labels = read_table(spark, sf_dir, "labels").where(language_id.fold_of("doc_id", 5) != 0)
    return weak.keep_clean(docs, weak.train(docs, labels))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays."""
    return near_dedup.keep_one(docs, similar=SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text."""
    out = secrets_scan.redact_secrets(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their words in the mix, and their draws: the shard, pass and position of every time one is taken."""
    return mixing.mix(docs, keep=True)


STAGES = [
    ("toxicity", toxicity),
    ("minhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources", mix_sources),
]

#: SQL can't express a fitted classifier, masking by guess cost or random draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
