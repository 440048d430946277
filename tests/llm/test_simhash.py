import random

import numpy as np
import xxhash

from keystead.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = {r: brute_fingerprint(r[1]) for r in rows}
    distinct = sorted(set(prints.values()))
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for (i, _), f in prints.items():
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return sorted((i if i is not None else -1, f"{f:016x}", least.get(find(f))) for (i, _), f in prints.items())


def result(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fingerprint"], r["component_id"]) for r in df.collect())


def test_masks_cover_every_pair():
    masks = [m & (2**64 - 1) for m in simhash.covering_masks()]
    assert len(masks) == 7
    assert all(any(not m & (1 << i | 1 << j) for m in masks) for i in range(64) for j in range(i, 64))


def test_fingerprint_of_long_and_odd_texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcÄé") for _ in range(rng.randint(1, 9))) for _ in range(4000)]
    for text in ["", " ", "one", "one two", "One TWO three", "a\xa0b c d", "\x1ca b c", " ".join(words), "\n".join(words)]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    text = " ".join(words * 250)  # several pieces
    assert len(text.encode()) > 1 << 22
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_documents_against_brute_force(documents, texts):
    assert result(simhash.near_duplicates(documents)) == brute_components(list(texts.items()))


def near_copies(n):
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 400)}" for _ in range(600)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = f"x{rng.randint(0, 99)}"
        rows.append((i, " ".join(own)))
    return rows


def test_large_group_of_near_copies(docs_of):
    rows = near_copies(300) + [(1000, None), (1001, ""), (1002, "  "), (1003, "other text here")]
    assert result(simhash.near_duplicates(docs_of(rows))) == brute_components(rows)


def test_links_of_random_prints(spark):
    rng = np.random.RandomState(1)
    centres = rng.randint(0, 2**62, 20).astype(np.int64)
    prints = sorted({int(c) ^ (1 << int(rng.randint(63))) ^ (1 << int(rng.randint(63))) for c in centres for _ in range(30)})
    links = {(r["a"], r["b"]) for r in simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    assert all(find(a) == find(b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 2)


def test_representatives(docs_of):
    rows = [(4, "same text of a few words"), (2, "same text of a few words"), (None, "alone with null id"), (7, None), (8, " ")]
    df = docs_of(rows)
    out = simhash.representatives(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, 2, 7]


def test_empty_table(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
    assert simhash.representatives(docs_of([])).count() == 0
