import hashlib
import re

import pytest

from keystead.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, items):
    grams = {}
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[a : a + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, ids = WORD.findall(lower(t)), set(), set()
        for n in {len(g) for g in grams}:
            for a in range(len(w) - n + 1):
                if found := grams.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    ids |= found
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


LONG = " ".join(f"word{i}" for i in range(30))
ITEMS = [(1, LONG), (2, "Short Item"), (3, None), (4, "..."), (5, "É b c d e f g h i j k l m n o"), (None, "null item here"), (10, "short item"), (2, "word0 word1")]
ROWS = [
    (1, f"intro {LONG.upper()} outro"), (2, "a short--item, SHORT item"), (3, None), (4, ""), (5, "!!!"), (6, "é b c d e f g h i j k l m n o"),
    (7, "É b c d e f g h i j k l m"), (8, " ".join(["pad"] * 2000) + " short item"), (8, "short item"), (None, "null item here"), (9, "word0 word1 " * 300),
    (10, " ".join(f"word{i}" for i in range(12))), (11, "日本 語 short item"), (12, "x" * 200_000 + " short item"),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, len string")


def test_against_brute_force(docs_of, items):
    assert result(decontaminate.contamination(docs_of(ROWS), items)) == brute(ROWS, ITEMS)


def test_beyond_the_broadcast_bound(docs_of, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontaminate, "BITMAP_BITS", 7)  # nearly every window is a candidate
    assert result(decontaminate.contamination(docs_of(ROWS), items)) == brute(ROWS, ITEMS)


def test_all_documents(spark, documents, texts, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = result(decontaminate.contamination(documents, bench))
    assert found == brute(texts.items(), [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert any(r[5] for r in found)


def test_spans(docs_of, items):
    row = decontaminate.contamination(docs_of([(1, f"intro {LONG} outro short item")]), items).first()
    assert [tuple(s) for s in row["spans"]] == [(2, 30), (33, 2)]


def test_filter_keeps_rows_and_columns(docs_of, items):
    df = docs_of(ROWS)
    out = decontaminate.decontaminated(df, items)
    assert out.columns == df.columns
    keep = sorted(str(r[0]) for r in brute(ROWS, ITEMS) if not r[5])
    assert sorted(str(r["doc_id"]) for r in out.collect()) == keep


def test_empty_tables(docs_of, items):
    none = items.limit(0)
    assert decontaminate.contamination(docs_of([]), items).count() == 0
    assert result(decontaminate.contamination(docs_of(ROWS[:3]), none)) == brute(ROWS[:3], [])


def test_no_python_in_the_plan(docs_of, items):
    plan = decontaminate.contamination(docs_of(ROWS), items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
