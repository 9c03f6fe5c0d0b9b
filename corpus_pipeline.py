"""The training-data pipeline: five stages over ``documents``.

Each stage is (name, function) with function(spark, docs, sf_dir) -> DataFrame;
its result is written as Parquet to the shared folder and reread as the next
stage's ``docs``. All stages but the last return the columns of ``docs``.

Stages: toxic documents go; of each group of near duplicates one document
stays; contaminated documents go; personal data is replaced by [KIND] (n_chars
follows the new text); the sources are mixed to their target weights, which
adds size, source_size, target, taken, repeats and finish (columns of these
names are replaced) and leaves out the documents that the mix does not take.

Cases: a null or empty text is not toxic, has no shingles, is no near duplicate,
not contaminated, stays null or empty, and is never taken by the mix (size 0).
Of equal rows one stays. A null doc_id is a document like others; a null source
is a source of its own. Ties go to the smallest doc_id (near duplicates) and by
the md5 order of ids (mix). Texts are read whole at any length. An empty table
gives no rows. Extra columns pass through all stages, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.llm import decontam, mixing, parity_join, pii, toxicity
from riskfold.llm.common import cut_lineage, prepare, small_enough, table, with_row_key


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"), keep=docs.columns)
    return scored.where(F.col(scored.columns[-1]) < toxicity.CUTOFF).select(docs.columns)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return parity_join.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns)
    return found.where(~F.col(found.columns[-1])).select(docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = pii.find_pii(docs, keep=docs.columns)
    spans = F.col(found.columns[-1])
    clean = F.when(F.col("text").isNotNull(), pii.redact(F.col("text"), spans))
    out = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length("text").cast(kind))
                             .otherwise(F.col("n_chars")))
    return out.select(docs.columns)


MIX_COLUMNS = ["size", "source_size", "target", "taken", "repeats", "finish"]


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    keyed, key = with_row_key(docs)
    taken = mixing.mix(keyed, keep=key).where("repeats > 0")
    taken = cut_lineage(taken.select(*key, *[F.col(c).alias(f"mix {c}") for c in MIX_COLUMNS]), "mix-taken")
    out = keyed.join(F.broadcast(taken) if small_enough(taken, 72) else taken, key)
    kept = [c for c in docs.columns if c.lower() not in MIX_COLUMNS]
    return out.select(*kept, *[F.col(f"mix {c}").alias(c) for c in MIX_COLUMNS])


STAGES = [
    ("toxicity", toxic_stage),
    ("ngram_jaccard_join", duplicate_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("pii", pii_stage),
    ("mixing", mix_stage),
]

# a trained classifier and set joins decide: not expressible in SQL, tested
# against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
