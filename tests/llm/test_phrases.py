import hashlib
import random

import numpy as np
import pytest

from keystead.llm import phrases


def brute(rows, window=50):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        if i is not None:
            for a in range(len(w) - window + 1):
                k = tuple(w[a : a + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for a in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[a : a + window])] < i:
                gone[a : a + window] = [True] * window
        left = [x for x, g in zip(w, gone) if not g]
        out.append((str(i), len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def words(rng, n, size=5000):
    return [f"w{rng.randint(0, size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    license_, passage, exact = words(rng, 60), words(rng, 130), words(rng, 50)
    out = []
    for i in range(60):
        body = words(rng, rng.randint(0, 120))
        if i % 2:
            body += license_
        if i % 5 == 0:
            body = passage[rng.randint(0, 40) : rng.randint(80, 130)] + body
        if i % 7 == 0:
            body = body[:10] + exact + body[10:]
        out.append((100 - i, " ".join(body)))
    out += [(200, out[3][1]), (201, out[3][1]), (202, "same " * 300), (203, "same " * 200), (204, None), (205, ""), (206, " ".join(exact)), (207, " ".join(exact[:49]))]
    out += [(None, out[3][1]), (200, out[5][1]), (208, "\t\n".join(license_).replace("w", "w\xa0")), (209, " ".join(license_[:49]) + " é " + license_[49])]
    a, b = words(rng, 80), words(rng, 80)
    out += [(300, " ".join(a + b)), (301, " ".join(a)), (302, " ".join(b)), (303, " ".join(a[20:] + b[:60])), (304, " ".join(b + a))]
    return out


def test_against_brute_force(docs_of, rows):
    assert result(phrases.remove_repeated(docs_of(rows))) == brute(rows)


def test_small_windows_and_few_shards(docs_of):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, 40, 2))) for i in range(25)]
    assert result(phrases.remove_repeated(docs_of(rows), window=6, shards=2)) == brute(rows, 6)


def test_all_rows_share_a_passage(docs_of):
    rng = random.Random(7)
    shared = words(rng, 55)
    rows = [(i, " ".join(words(rng, 3) + shared + words(rng, 3))) for i in range(400)]
    out = result(phrases.remove_repeated(docs_of(rows)))
    assert out == brute(rows) and sum(r[2] for r in out) >= 55 * 399


def test_kept_text(docs_of):
    rng = random.Random(8)
    shared = words(rng, 50)
    out = phrases.remove_repeated(docs_of([(1, " ".join(shared)), (2, " ".join(["a", *shared, "é"]))])).collect()
    assert {r["doc_id"]: r["kept"] for r in out} == {1: " ".join(shared), 2: "a é"}


def test_documents(documents, texts):
    assert result(phrases.remove_repeated(documents, texts=False)) == brute(list(texts.items()))


def test_empty_table(docs_of):
    assert phrases.remove_repeated(docs_of([])).count() == 0


def test_hashes_are_of_words():
    rng = random.Random(1)
    own = words(rng, 200)
    h, anchors = phrases.windows(" ".join(own))
    again, same = phrases.windows("other words before " + "\n".join(own))
    assert np.array_equal(h, again[3:]) and np.array_equal(anchors, same[3:]) and len(h) == 151
    assert len(phrases.windows("too short")[0]) == 0
