"""The pipeline's stages in turn, each held against a brute-force version on what the one before kept."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from test_llm_operators import components, shingle_set

from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    good = ["the", "of", "and", "word,", "Text.", "plain", "is", "on", *(f"n{i}" for i in range(200))]
    text = lambda n: " ".join(rng.choice(good) for _ in range(n))
    rows = [(i, text(rng.randint(20, 80)), "en", f"s{i % 3}") for i in range(300)]
    item = text(20)
    rows += [(300 + i, " ".join(rng.choice(["BUY!!", "NOW!!", "x%%%", "y###"]) for _ in range(30)), "en", "s0") for i in range(60)]
    rows += [(400 + i, rows[5][1] + f" more{i}", "en", "s1") for i in range(20)]
    rows += [(430, rows[9][1], "en", "s2"), (9, rows[9][1], "en", "s2"), (440, text(30) + " " + item + " " + text(30), "en", "s0"), (450, text(20) + " password=hunter22 " + text(20), "en", None), (None, text(40), "de", "s1")]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(not 300 <= i < 360), 0) for i in range(360)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, corpus):
    import corpus_pipeline as p

    from motifold.llm.quality import fit, scored

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = p.quality(spark, docs, corpus)
    want = {r["doc_id"] for r in scored(docs, fit(docs, spark.read.parquet(f"{corpus}/labels.parquet"))).where("predicted = 1").collect()}
    rows = kept.collect()
    assert kept.columns == docs.columns and {r["doc_id"] for r in rows} == want and not any(300 <= (d or 0) < 360 for d in want) and len(want) > 300

    kept = spark.createDataFrame(rows, docs.schema)
    sets = [(r["doc_id"], shingle_set(r["text"])) for r in rows if r["doc_id"] is not None]
    links = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[:i] if a != b and s and t and 100 * len(s & t) >= 75 * len(s | t)]
    of = components({d for d, _ in sets}, links)
    rows = p.near_duplicates(spark, kept, corpus).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter({d: 1 for d in of if of[d] == d}) + Counter({None: 1} if None in want else {})

    kept = spark.createDataFrame(rows, docs.schema)
    item = shingle_set(spark.read.parquet(f"{corpus}/benchmark.parquet").first()["text"])
    clean = p.decontamination(spark, kept, corpus)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in rows if 100 * len(shingle_set(r["text"]) & item) < 75 * len(item)}

    masked = p.secret_scan(spark, clean, corpus)
    assert masked.columns == docs.columns and masked.count() == clean.count()
    by = {r["doc_id"]: r for r in masked.collect()}
    for r in clean.collect():
        assert by[r["doc_id"]]["text"] == re.sub(r"password=\S+", "[SECRET]", r["text"]) and by[r["doc_id"]]["n_chars"] == len(by[r["doc_id"]]["text"])

    mix = p.mixing(spark, masked, corpus)
    per = mix.groupBy("doc_id", "source", "taken", "size").agg(F.sum("words").alias("words"), F.count("*").alias("n")).collect()
    assert all(r["words"] == r["taken"] <= 3 * r["size"] and r["n"] <= 3 for r in per)
    for r in mix.groupBy("source", "target").agg(F.sum("words").alias("w")).collect():
        assert abs(r["w"] - r["target"]) <= 1


def test_run(spark, corpus):
    import corpus_pipeline as p

    first = Counter(map(tuple, p.run(spark, corpus).collect()))
    assert first and first == Counter(map(tuple, p.run(spark, corpus).collect()))
    assert len(p.STAGES) == 5


def test_stages_of_nothing(spark, corpus):
    """No documents, or none with a text, in every stage."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    blank = spark.createDataFrame([(1, None, None, None, None), (None, "", "en", "s", 0), (1, " \n", "en", None, 2)], docs.schema)
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), corpus).count() == 0, name
        rows = stage(spark, blank, corpus).collect()
        assert len(rows) <= 3 and (name != "secret scans" or Counter(map(tuple, rows)) == Counter(map(tuple, blank.withColumn("n_chars", F.length("text").cast("long")).collect()))), name
