import pytest

import __spark_entry__ as entry
import corpus_pipeline
from keystead.llm import bpe, decontaminate, exact_dedup, toxicity
from tests.compare import difference, duck, duck_rows, spark_rows
from tests.llm.test_near import brute

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_in_order():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["toxic", "exact", "near", "benchmark", "tokens"]


def test_every_stage_does_its_part(spark, documents, sf_dir):
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    docs, columns = documents, documents.columns
    want = {
        "toxicity": lambda d: ids(toxicity.scores(d, labels).where("predicted = 0")),
        "exact dedup": lambda d: ids(exact_dedup.duplicate_rows(d).where("kept")),
        "near dedup": lambda d: brute([(r["doc_id"], r["text"]) for r in d.collect()]),
        "decontamination": lambda d: ids(decontaminate.contamination(d, bench).where("not contaminated")),
    }
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf_dir)
        assert out.columns == columns
        assert ids(out) == want[name](docs), name
        docs = spark.createDataFrame(out.collect(), out.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert ids(last) == ids(docs)
    path = corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")
    back = {r["doc_id"]: r["text"] for r in bpe.decode(last, path).collect()}
    assert back == {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert ids(corpus_pipeline.run(spark, sf_dir)) == ids(last)


def test_empty_stages(spark, documents, sf_dir):
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, documents.limit(0), sf_dir).count() == 0


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_sql(spark, name):
    want = duck_rows(duck(SF), entry.oracle_sql()[name])
    assert want[1] and difference(spark_rows(entry.queries()[name](spark, SF)), want) is None


def test_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names} and "pipeline" in names
