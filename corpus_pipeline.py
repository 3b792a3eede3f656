"""Training-data pipeline over ``documents``: quality rules, near duplicates,
benchmark decontamination, secret redaction, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``. ``run`` writes each stage's result to the shared
folder and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.llm.common import scratch_table, table
from seqlens.llm.decontaminate import contamination
from seqlens.llm.jaccard_join import jaccard_components
from seqlens.llm.mixing import mix
from seqlens.llm.quality_rules import quality
from seqlens.llm.secret_scan import redacted

SHINGLE_WORDS, SIMILARITY = 5, (4, 5)


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their script's fertility bands."""
    return quality(docs, into="__quality").where("__quality.kept").select(*docs.columns)


def ngram_jaccard_join(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard
    similarity 0.8 or more, reachable by links): the one with the smallest
    doc_id. Rows that agree in doc_id and text are one document; texts without
    words stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ident = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    rows = docs.withColumn("__id", ident)
    signed, classes = jaccard_components(rows.select("__id", "text"), id_col="__id", shingle_words=SHINGLE_WORDS, threshold=SIMILARITY)
    keep = classes.select(F.col("component_id").alias("__id")).union(signed.where("cid is null").select("doc_id")).distinct()
    return rows.join(scratch_table(keep, "keep"), "__id", "left_semi").dropDuplicates(["__id"]).select(*docs.columns)


def benchmark_decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    return contamination(docs, table(spark, sf_dir, "benchmark"), into="__hits").where("not __hits.contaminated").select(*docs.columns)


def secret_scan(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets cut out of their texts."""
    out = redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, document by document as drawn."""
    return mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
]

#: SQL cannot express the tokeniser of the first stage; the tests compare every
#: stage with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
