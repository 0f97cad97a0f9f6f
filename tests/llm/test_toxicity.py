import zlib

import pytest

from geomarket.llm import toxicity


@pytest.fixture(scope="module")
def model_and_docs(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return toxicity.train(docs, labels), docs, labels


def test_held_out_accuracy(model_and_docs):
    model, docs, labels = model_and_docs
    held = toxicity.score(docs.join(labels, "doc_id"), model).select("doc_id", "toxic", "score").collect()
    held = [r for r in held if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in held)
    found = sum(r.score >= 0.5 for r in held if r.toxic)
    assert right / len(held) >= 0.97 and found / sum(r.toxic for r in held) >= 0.75


def test_sentences_are_located(spark, model_and_docs):
    model = model_and_docs[0]
    text = "Of the thing and the house. Such a pathetic moron he is. More of the rest.\nÉ pathetic idiot! And so on."
    docs = spark.createDataFrame([(1, text), (2, "Of the thing and the house. More of the rest.")], "doc_id long, text string")
    found = sorted((r.doc_id, text.encode()[r.start:r.end].decode().strip()) for r in toxicity.locate(docs, model).collect())
    assert found == [(1, "Such a pathetic moron he is"), (1, "É pathetic idiot")]


def test_noisy_or_of_sentences(spark, model_and_docs):
    model = model_and_docs[0]
    parts = ["a pathetic clown", "of the thing", "some moron"]
    docs = spark.createDataFrame([(".".join(parts),), *[(p,) for p in parts], ("",), (None,), (". !\n",)], "text string")
    whole, *each = [r.score for r in toxicity.score(docs, model).collect()]
    assert whole == pytest.approx(1 - (1 - each[0]) * (1 - each[1]) * (1 - each[2]))
    assert each[3:5] == [0, 0] and each[5] < 0.01


def test_odd_rows(odd_docs, no_docs, spark, small_dir):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 1), (5, 0, None), (6, 1, 0), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    found = toxicity.judge_documents(odd_docs, labels).collect()
    assert len(found) == odd_docs.count() and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    kept = toxicity.drop_toxic(odd_docs, labels)
    assert kept.schema == odd_docs.schema and kept.count() > 0
    assert toxicity.judge_documents(no_docs, labels).count() == 0
    assert toxicity.judge_documents(odd_docs, labels.where("false")).count() == odd_docs.count()
