import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from keystead.llm import near, simhash


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The smallest doc_id of every component of pairs with Jaccard >= 0.8."""
    sets = {i: shingle_set(t) for i, t in rows}
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if 5 * len(x & y) >= 4 * len(x | y):
                least[max(find(a), find(b))] = min(find(a), find(b))
    return sorted({find(i) for i in ids})


def kept(df):
    return sorted(r["doc_id"] for r in df.collect())


def edited(n, edits):
    """Near copies of three texts that share a passage, with words changed."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    bases = [passage + [f"w{rng.randint(0, 900)}" for _ in range(size)] for size in (120, 200, 400)]
    rows = []
    for i in range(n):
        own = list(bases[i % 3])
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"x{rng.randint(0, 99)}"
        rows.append((i, " ".join(own)))
    return rows


def test_ordinary_near_copies_go(spark, docs_of, sf_dir):
    rows = edited(2, 0)[:1] + [(7, edited(1, 0)[0][1].replace("p7 ", "q7 ").replace("p40 ", "q40 "))]
    assert len(simhash.representatives(docs_of(rows)).collect()) == 2  # beyond the radius of op1
    assert kept(corpus_pipeline.near(spark, docs_of(rows), sf_dir)) == [0]


def test_against_brute_force(docs_of):
    rows = edited(90, 14) + [(200, None), (201, " "), (202, "one two"), (203, "ONE  two"), (204, "one two three four five six")]
    want = brute(rows)
    assert 10 < len(want) < 90
    assert kept(near.representatives(docs_of(rows))) == want


def test_documents_against_brute_force(documents, texts):
    want = brute(list(texts.items()))
    assert kept(near.representatives(documents)) == want and len(want) < len(set(texts.values()))


def test_shingles_of_pieces():
    text = " ".join(f"w{i % 70_001}" for i in range(900_000))
    assert len(text) > 1 << 22 and len(near.shingles(text)) == 70_001


def test_many_texts_that_share_their_first_words(docs_of):
    """No two are similar, though all lead with the same words; 40 more are copies with an edit."""
    rng = random.Random(12)
    opening = " ".join(f"o{i}" for i in range(30))
    rows = [(i, f"{opening} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(50))) for i in range(5000)]
    rows += [(5000 + i, f"{rows[i][1]} end{i}") for i in range(40)]
    assert kept(near.representatives(docs_of(rows, extra=False))) == list(range(5000))


def test_filters_lose_no_pair():
    """The signature and the places never rule out what is similar."""
    rng = random.Random(13)
    for _ in range(300):
        size = rng.randint(1, 400)
        a = np.unique(np.array([rng.getrandbits(63) for _ in range(size)]))
        b = a.copy()
        for k in range(rng.randint(0, size // 6)):
            b[rng.randrange(len(b))] = rng.getrandbits(63)
        b = np.unique(b)
        if not near.similar(a, b):
            continue
        flips = int(np.bitwise_count((near.signature(a) ^ near.signature(b)).view(np.uint64)).sum())
        assert 9 * flips <= len(a) + len(b)
        none = np.zeros(0, dtype=np.int64)
        x, y = near.leading(a, none, none).tolist(), near.leading(b, none, none).tolist()
        h = min(set(x) & set(y))
        assert 9 * min(len(a) - x.index(h), len(b) - y.index(h)) >= 4 * (len(a) + len(b))


def test_staged_tables_are_removed(spark, docs_of, tmp_path):
    import os
    from keystead.session import scratch_root
    before = set(os.listdir(scratch_root(spark).removeprefix("file:")))
    near.representatives(docs_of(edited(30, 5))).count()
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(scratch_root(spark).removeprefix("file:"))) - before}
    assert left <= {"links", "stars", "rows", "representatives", "repeated"}


def test_fingerprints_name_the_first_pairs(docs_of):
    """Texts within two bits are joined by SimHash alone, and only where their sets are similar."""
    base = [f"w{i}" for i in range(4000)]
    rows = [(0, " ".join(base)), (1, " ".join([*base, "end"])), (2, "a b c d e"), (3, "f g h i j"), (4, None), (5, "A b C d e")]
    every = near.sets(docs_of(rows)).localCheckpoint()
    prints = {r["doc_id"]: (r["fp"], r["s"]) for r in every.collect()}
    assert prints[4][0] == 0 and prints[2] == prints[5]
    assert (prints[0][0] ^ prints[1][0]).bit_count() <= 2 and prints[0][1] != prints[1][1]
    assert all(f & (2**64 - 1) == simhash.fingerprint(dict(rows)[i] or "", near.WORDS) for i, (f, _) in prints.items())
    found = {(r["a"], r["b"]) for r in near.fingerprint_pairs(every).collect()}
    assert tuple(sorted((prints[0][1], prints[1][1]))) in found
    assert all(min((prints[i][0] ^ prints[k][0]).bit_count() for i in prints for k in prints if {prints[i][1], prints[k][1]} == {a, b}) <= 4 for a, b in found)
    assert kept(near.representatives(docs_of(rows))) == [0, 2, 3, 4]


def test_wide_signatures_lose_no_pair():
    """They fold to any shorter length, never rule out what is similar, and tell long sets apart."""
    rng = random.Random(14)
    for _ in range(100):
        a = np.unique(np.array([rng.getrandbits(63) for _ in range(rng.randint(1, 3000))]))
        b = a.copy()
        for k in range(rng.randint(0, len(a) // 6)):
            b[rng.randrange(len(b))] = rng.getrandbits(63)
        b = np.unique(b)[rng.randint(0, len(b) // 20) :]
        x, y = near.wide_signature(a), near.wide_signature(b)
        assert (x is None) == (len(a) <= near.WIDE)
        if x is None or y is None:
            continue
        assert near.differing(x, near.signature(a).tobytes()) == 0
        if near.similar(a, b):
            assert 9 * near.differing(x, y) <= len(a) + len(b)
        other = np.unique(np.array([rng.getrandbits(63) for _ in range(len(a))]))
        assert 9 * near.differing(x, near.wide_signature(other)) > len(a) + len(other)


def test_long_texts_that_share_a_passage_are_not_read(docs_of, monkeypatch):
    """256 bits tell nothing of long sets: without wide signatures all these pairs had their whole sets verified."""
    rng = random.Random(15)
    passage = " ".join(f"p{i}" for i in range(60))
    long = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(1500)) + f" {passage}" for _ in range(40)]
    rows = list(enumerate(long)) + [(100 + i, f"{t} end{i}") for i, t in enumerate(long[:5])]
    asked, verified = [], near.verified

    def spy(docs, keys, pairs, *rest):
        pairs = pairs.localCheckpoint()
        asked.extend((r["a"], r["b"]) for r in pairs.collect())
        return verified(docs, keys, pairs, *rest)

    monkeypatch.setattr(near, "verified", spy)
    assert kept(near.representatives(docs_of(rows, extra=False))) == list(range(40))
    assert len(set(asked)) == 5


def test_a_pair_is_made_once_for_a_run(docs_of, monkeypatch):
    """Two copies with an edit share many leading shingles, but meet at the first of a run only."""
    words = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(words)), (1, " ".join([*words, "end"]))]
    monkeypatch.setattr(near, "common_shingles", lambda docs, words=5: (np.zeros(0, dtype=np.int64),) * 2)
    every = near.sets(docs_of(rows, extra=False)).localCheckpoint()
    entries = near.recurring_entries(every).localCheckpoint()
    x, y = entries.alias("x"), entries.alias("y")
    shared = x.join(y, (near._of("x", "h") == near._of("y", "h")) & (near._of("x", "s") < near._of("y", "s")))
    assert shared.count() > 50 and 1 <= shared.where(near._first_of_run("x", "y")).count() <= 2
    assert entries.where("prev is null").count() == 2


def test_copies_of_many_shingles_meet_their_pivots_once(docs_of, monkeypatch):
    """More sets than FEW share their leading shingles: the pairs of a round are distinct, components as before."""
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*words, f"end{i}"])) for i in range(60)] + [(100 + i, " ".join([*words[:60], *[f"v{i}x{k}" for k in range(140)]])) for i in range(30)]
    pivots, made = near._pivot_pairs, []

    def spy(*args):
        pairs = pivots(*args).localCheckpoint()
        made.append((pairs.count(), pairs.distinct().count()))
        return pairs

    monkeypatch.setattr(near, "_pivot_pairs", spy)
    none = lambda every: near.stage(every.where("false").select(F.col("s").alias("a"), F.col("s").alias("b")), "none")
    monkeypatch.setattr(near, "fingerprint_pairs", none)  # they would join the copies first
    assert kept(near.representatives(docs_of(rows, extra=False))) == brute(rows)
    assert made and all(a == b for a, b in made)


def test_the_counted_sample_changes_no_result(docs_of, monkeypatch):
    """Whatever the order knows as common, no shingle or a third of them with made-up counts, the same rows stay."""
    rows = edited(30, 14) + [(200, None), (201, " "), (202, "one two")]
    every = np.unique(np.concatenate([near.shingles(t or "") for _, t in rows]))
    want = brute(rows)
    for common in (every[:0], every[::3]):
        counts = np.random.default_rng(3).integers(1, 99, len(common))
        monkeypatch.setattr(near, "common_shingles", lambda docs, words=near.WORDS, c=(common, counts): c)
        assert kept(near.representatives(docs_of(rows))) == want
