"""The corpus pipeline: stages that each take the documents which the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifold.llm.decontam import clean_documents
from motifold.llm.jaccard_join import jaccard_components
from motifold.llm.mixing import mixed
from motifold.llm.quality import accepted, fit
from motifold.llm.secrets import redacted
from motifold.llm.shared import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return accepted(docs.select(*COLUMNS), fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of smallest id; of rows that share an id, one.  Rows without an id stay."""
    found, _ = stored(jaccard_components(docs).select("doc_id", "component_id").where("doc_id is not null"), "components")
    kept = docs.select(*COLUMNS).join(found.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)
    again, _ = stored(found.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.head() is None:
        return kept
    rest = F.struct(*(c for c in COLUMNS if c != "doc_id"))
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(rest).alias("x")).select("doc_id", "x.*").select(*COLUMNS)
    return kept.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced; every document stays."""
    return redacted(docs.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes: ``words`` is the copy's share of the mix, less than ``size`` for the last."""
    taken = mixed(docs, ("text", "lang", "source"))
    copies = taken.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    return copies.select("doc_id", "text", "lang", "source", "size", "source_size", "target", "taken", "copy", words.alias("words"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secret_scan), ("mixing to target weights", mixing)]

#: The classifier can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
