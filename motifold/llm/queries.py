"""One thin query for each operator of this subpackage, over whole tables, in the form that its contract states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, html_text, mixing, pii, secrets
from .decontam import contained_items
from .jaccard_join import jaccard_components
from .near_vectors import near_vectors
from .ngram_lm import language_scores
from .quality import fit, scored
from .shared import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat_format.digests(conversations.unionByName(probe))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return scored(documents, fit(documents, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.SQL, "op7_decontamination": OP7_SQL}


#: Words of a text as the operators take them.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
OP7_SQL = f"""
WITH i AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
si AS (SELECT DISTINCT item_id, w, w[k : k + 4] AS s FROM i, unnest(range(1, greatest(2, len(w) - 3))) AS t(k) WHERE len(w) > 0),
ni AS (SELECT item_id, w, count(*) AS n FROM si GROUP BY ALL),
sizes AS (SELECT DISTINCT len(s) AS z FROM si),
sd AS (SELECT DISTINCT r, doc_id, w[k : k + z - 1] AS s FROM d, sizes, unnest(range(1, len(w) - z + 2)) AS t(k))
SELECT doc_id, si.item_id, count(*) AS n_shared, n AS n_item, count(*) / n::DOUBLE AS containment
FROM sd JOIN si USING (s) JOIN ni ON ni.item_id = si.item_id AND ni.w = si.w
GROUP BY r, doc_id, si.item_id, si.w, n HAVING 100 * count(*) >= 75 * n
"""
