import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keystead.llm import bpe
from keystead.llm.lexicon import Lexicon, compile_lexicon

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(PATH)


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


ODD = [
    "", " ", "\n\n x", "don't we'll I'VE 's", "x<|endoftext|>y <|endoftext|> ", "<|endoftext|><|endoftext|>", "a  b   c \t d　e\xa0f\x85g\x1ch", "日本語テキスト 한국어 ١٢٣ ⅷ²",
    "😀😃 é ‍", "a" * 4000, "!?" * 900, "1234567890" * 50, "ab " * 3000, "\x00\x01", "word.Next,then;", "È".join("abcdef"), " lead", "trail ", "\r\n\r\n",
]


def test_texts_like_the_library(docs_of, library):
    rows = list(enumerate(ODD)) + [(100, None), (None, "null id"), (3, "repeated"), (3, "repeated")]
    out = bpe.digests(bpe.encode(docs_of(rows), PATH), PATH).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == sorted((str(i), *want(library, t)) for i, t in rows)


def test_documents_like_the_library(documents, texts, library):
    out = {r["doc_id"]: tuple(r)[1:] for r in bpe.digests(bpe.encode(documents, PATH), PATH).collect()}
    assert out == {i: want(library, t) for i, t in texts.items()}


def test_random_texts(library, merges):
    rng = random.Random(4)
    signs = " \n\t　\xa0'streldvm09aé<>.,!-\x1c\x85日"
    encoder = bpe.Encoder(merges, Lexicon(compile_lexicon({b" ab": merges.merge(b" ab"), b"the": merges.merge(b"the")})))
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
        assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_pieces_and_forgetting(library, merges, monkeypatch):
    text = " ".join(f"word{i % 700} and\nmore" for i in range(3000))
    monkeypatch.setattr(bpe, "MEMO", 50)
    encoder = bpe.Encoder(merges, Lexicon(compile_lexicon({})))
    assert "".join(bpe.text_pieces(text, 1000)) == text
    got = [i for p in bpe.text_pieces(text, 1000) for i in encoder.encode(p)]
    assert got == library.encode(text, add_special_tokens=False).ids


def test_round_trip(docs_of):
    rows = list(enumerate(ODD))
    back = bpe.decode(bpe.encode(docs_of(rows), PATH), PATH)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(rows)


def test_lexicon_finds_its_words_only():
    rng = random.Random(8)
    words = {bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 7))): [rng.randint(0, 9) for _ in range(rng.randint(1, 4))] for _ in range(900)}
    lexicon = Lexicon(compile_lexicon(words))
    asked = list(words) + [b"", b"zz", b"abcdabcdabcd", b"a" * 99]
    places = lexicon.places(asked).tolist()
    assert [lexicon.ids_at(p).tolist() if p >= 0 else None for p in places] == [words.get(w) for w in asked]
    # suffixes are shared: fewer arcs than a tree of prefixes has
    assert len(lexicon.keys) < len({w[:i] for w in words for i in range(1, len(w) + 1)})


def test_counts_are_over_all_documents(docs_of):
    out = bpe.word_counts(docs_of([(1, "the cat the"), (2, "the cat"), (3, None)]))
    assert {bytes(r["word"]): r["n"] for r in out.collect() if r["word"]} == {b"the": 2, b" cat": 2, b" the": 1}


def test_empty_table(docs_of):
    assert bpe.encode(docs_of([]), PATH).count() == 0


def test_one_worker_encodes_and_digests(docs_of, library):
    """Equal to the two operators one after the other, in one Python step."""
    rows = list(enumerate(ODD)) + [(100, None), (None, "null id"), (3, "repeated"), (3, "repeated")]
    out = bpe.encoded_digests(docs_of(rows), PATH, with_ids=True)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = out.collect()
    assert sorted((str(r["doc_id"]), *r[1:4]) for r in got) == sorted((str(i), *want(library, t)) for i, t in rows)
    assert all(hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() == r["ids_sha256"] for r in got)


def test_remembered_ids_are_packed(library, merges):
    encoder = bpe.Encoder(merges, Lexicon(compile_lexicon({b" the": merges.merge(b" the")})))
    text = "the the qwzxqwzx don't 1234567 日本語"
    assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert {s: len(i) for s, i in encoder.memo.items()} == {s: 4 * len(library.encode(s, add_special_tokens=False).ids) for s in encoder.memo}
