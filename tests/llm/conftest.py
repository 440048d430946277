import pytest

# Names that the operators use inside must not clash with columns that tables bring along.
EXTRA = {"fp": "long", "key": "string", "row": "long", "shard": "string", "n": "int", "all": "string", "_id": "long", "w": "int", "h": "string", "doc": "string", "slot": "int"}


@pytest.fixture(scope="session")
def docs_of(spark):
    """docs_of([(doc_id, text), ...]): a table of documents with columns that clash."""

    def make(rows, extra=True):
        more = EXTRA if extra else {}
        kind = "doc_id long, text string" + "".join(f", `{k}` {t}" for k, t in more.items())
        values = {"long": 1, "int": 2, "string": "x"}
        return spark.createDataFrame([(*r, *(values[t] for t in more.values())) for r in rows], kind)

    return make


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.collect()}
