"""The pipeline's stages, each on its own input, against brute force; then run() as a whole."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    words = ["".join(rnd.choice(["ti", "on", "the", "er", "an", "re"]) for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = [prose(rnd.randint(30, 120)) for _ in range(260)]
    for i in range(200, 230):  # copies and near copies of earlier ones
        w = texts[i - 200].split()
        if i % 2:
            w[-1] = "other"
        texts[i] = " ".join(w)
    texts[230] += " write to jane.roe@mail.example.com or 4111111111111111"
    texts += ["%%% &&& !!! ###" * 20 for _ in range(8)] + [None, ""]
    rows = [(i, t, "en" if i % 3 else None, "s0" if i % 3 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 200)] + [(i, 0, 0) for i in range(260, 266)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "PII surrogates", "source mixing", "best-fit packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = {}
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), folder)
        stages[name] = docs.collect()
        assert name == names[-1] or docs.columns == COLUMNS

    judged = {r.doc_id for r in stages["quality classifier"]}
    assert len(judged & set(range(260))) >= 240 and not judged & set(range(260, 270))  # some forty texts set the threshold

    sets = {r.doc_id: shingles(r.text) for r in stages["quality classifier"]}
    group = {a: a for a in sets}
    for a in sorted(sets):
        for b in sets:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert sorted(r.doc_id for r in stages["n-gram Jaccard join"]) == sorted(set(group.values()))

    before = {r.doc_id: r for r in stages["n-gram Jaccard join"]}
    for r in stages["PII surrogates"]:
        if r.doc_id == 230:
            assert "jane.roe" not in r.text and "4111111111111111" not in r.text and r.text.startswith(before[230].text[:40])
        else:
            assert r.text == before[r.doc_id].text
        assert r.n_chars == len(r.text)

    drawn = Counter(r.doc_id for r in stages["source mixing"])
    assert set(drawn) == {r.doc_id for r in stages["PII surrogates"]} and max(drawn.values()) <= 2

    from wardlight.llm.vocab import BytePairs

    text = {r.doc_id: r.text for r in stages["source mixing"]}
    pairs, filled = BytePairs(), defaultdict(int)
    for r in stages["best-fit packing"]:
        own = pairs.ids(text[r.doc_id]).tobytes() + np.asarray([0], "<u4").tobytes()
        assert zlib.crc32(own[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(filled.values()) // 2048) + 1
    assert Counter(r.doc_id for r in stages["best-fit packing"]) == drawn  # none is longer than a sequence


def test_filters_keep_rows_without_an_id(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    lost = docs.where("doc_id in (0, 1)").withColumn("doc_id", F.lit(None).cast("long"))
    given = docs.unionByName(lost).unionByName(lost)
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, given, folder).where("doc_id is null").count() == 4


def test_dedup_keeps_both_texts_of_an_id(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id in (40, 41)")
    other = docs.where("doc_id = 41").withColumn("doc_id", F.lit(40).cast("long"))
    more = docs.where("doc_id = 40").withColumn("text", F.concat(F.lit("another text of this id with words of its own "), F.reverse("text")))
    got = corpus_pipeline.ngram_dedup(spark, docs.unionByName(other).unionByName(more).unionByName(more), folder).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == 3 and {r.text for r in got} == {*texts.values(), more.first().text}


def test_stages_on_empty_and_unlabelled_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).count() == docs.where("length(text) > 0").count()


def test_run_is_the_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0
    assert got.where(F.col("doc_id") >= 260).count() == 0
