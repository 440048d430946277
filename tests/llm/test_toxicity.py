import random

import numpy as np
import pytest

from keystead.llm import toxicity


def make(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{chr(97 + rng.randint(0, 25))}{chr(97 + rng.randint(0, 25))}" for _ in range(rng.randint(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["horrid", "vilebeast", "vilefoe", "vileness", "nastiest"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def case(spark, docs_of):
    rows, labels = make(900)
    more = [(5000, None), (5001, ""), (None, "horrid vilefoe nastiest"), (0, rows[0][1]), (5002, "clean " * 100_000), (5003, "horrid vilefoe " * 50_000)]
    return docs_of(rows + more), spark.createDataFrame([(i, t, 1) for i, t in labels] + [(1, None, 1), (None, 1, 1), (99_999, 1, 1)], "doc_id long, toxic int, quality int")


def test_scores(case, spark):
    docs, labels = case
    out = toxicity.scores(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    truth = {r["doc_id"]: r["toxic"] for r in labels.where("toxic is not null and doc_id is not null").collect()}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 200 and sum(p == t for p, t in held) >= 0.98 * len(held)
    by = {r["doc_id"]: r for r in out}
    assert by[5000]["predicted"] == by[5001]["predicted"] == by[5002]["predicted"] == 0
    assert by[5003]["predicted"] == 1 and by[5003]["neighbours"]
    assert len([r for r in out if r["doc_id"] == 0]) == 2


def test_held_out_labels_are_not_learned(case):
    from pyspark.sql import functions as F

    docs, labels = case
    index = toxicity.build_index(docs, labels)
    import zlib
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in index.example_ids)
    turned = labels.withColumn("toxic", F.when(toxicity.fold() == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = sorted((str(r["doc_id"]), r["score"]) for r in toxicity.scores(docs, labels).collect())
    assert a == sorted((str(r["doc_id"]), r["score"]) for r in toxicity.scores(docs, turned).collect())


def test_nearest_are_exact(case):
    docs, labels = case
    index = toxicity.build_index(docs, labels)
    vectors = np.zeros((len(index.ids), len(index.weights)))
    for at, size, row, term, value in index.blocks:
        vectors[at + row, term] = value
    for text in [r["text"] for r in docs.limit(300).collect()]:
        query = index.unit(index.terms.counts(text or ""))
        dense = np.zeros(len(index.weights))
        dense[query[0]] = query[1]
        cosine = np.round(vectors @ dense, 12)
        want = sorted(((-c, i) for c, i in zip(cosine.tolist(), index.ids.tolist()) if c > 0))[: index.nearest]
        got = [(-c, int(index.ids[i])) for c, i in index.neighbours(query)]
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([c for c, _ in got], [c for c, _ in want])


def test_accepted_keeps_rows_and_columns(case):
    docs, labels = case
    index = toxicity.build_index(docs, labels)
    out = toxicity.accepted(docs, labels, index)
    assert out.columns == docs.columns
    good = sorted(str(r["doc_id"]) for r in toxicity.scores(docs, labels, index).where("predicted = 0").collect())
    assert sorted(str(r["doc_id"]) for r in out.collect()) == good


def test_without_examples(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.scores(docs_of([(1, "text"), (2, None)]), none).collect()] == [0.0, 0.0]
    assert toxicity.scores(docs_of([]), none).count() == 0


def test_given_documents(spark, documents, sf_dir):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = toxicity.scores(docs, labels).join(labels, "doc_id").where("held_out")
    wrong = out.where("toxic = 0 and predicted = 1").count()
    assert wrong <= 1


def test_counts_are_handed_on_in_parts(case, monkeypatch):
    """Terms are the same however few counts a task holds."""
    docs, labels = case
    rows = toxicity.sample(docs, labels)
    want = toxicity.pick_terms(rows)
    monkeypatch.setattr(toxicity, "COUNTED", 30)
    monkeypatch.setattr(toxicity, "PART", 7)
    assert want and toxicity.pick_terms(rows) == want
