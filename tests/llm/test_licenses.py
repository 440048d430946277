import random
import re

import pytest

from keystead.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    """Base columns and notice labels by comparing words at every place."""
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, base, labels = [], set(), set()
    for phrases, is_base in ((licenses.BASE, True), (licenses.NOTICES, False)):
        for phrase, label in phrases.items():
            own = phrase.split()
            for i in range(len(words) - len(own) + 1):
                if words[i : i + len(own)] == own:
                    labels.add(label)
                    if is_base:
                        starts.append(i)
                        base.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels))


def value(text):
    return licenses.evaluated(licenses.expression_tokens(text.lower(), 0))


def test_documents_against_brute_force(documents, texts):
    rows = {r["doc_id"]: r for r in licenses.scan(documents).collect()}
    assert set(rows) == set(texts)
    for i, text in texts.items():
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == brute(text)
        assert r["score"] == max((licenses.LEVELS[x] for x in r["labels"].split(",") if x), default=0.0)


def test_random_texts_against_brute_force(monkeypatch):
    rng, scanner = random.Random(7), licenses.Scanner()
    pool = ["cc", "by", "nc", "sa", "general", "public", "license", "all", "rights", "reserved", "lesser", "mit", "Apache", "x", "É", "9"]
    cut = [lambda t: [t], lambda t: re.findall(r"\S+\s*|\s+", t), lambda t: re.findall(r"(?:\S+\s*){1,3}|\s+", t)]
    for k in range(3000):
        text = "".join(rng.choice(pool) + rng.choice([" ", "-", "\n", ", ", "_", " "]) for _ in range(rng.randint(0, 40)))
        monkeypatch.setattr(licenses, "text_chunks", cut[k % 3])  # pieces of any size give the same
        assert scanner.scan(text)[:6] == brute(text), text


@pytest.mark.parametrize("text, labels, score", [
    ("MIT", {"mit"}, 0.2),
    ("MIT OR GPL-3.0-only", {"mit", "gpl"}, 0.2),
    ("MIT AND GPL-3.0-or-later", {"mit", "gpl"}, 0.6),
    ("MIT OR Apache-2.0 AND AGPL-3.0", {"mit", "apache", "agpl"}, 0.2),  # and binds closer
    ("(MIT OR Apache-2.0) AND AGPL-3.0", {"mit", "apache", "agpl"}, 0.7),
    ("GPL-2.0-only WITH Classpath-exception-2.0", {"gpl"}, 0.4),
    ("GPL-2.0 WITH Classpath-exception-2.0 AND MIT OR CC-BY-NC-4.0", {"gpl", "mit", "cc-by-nc"}, 0.4),
    ("((MIT))", {"mit"}, 0.2),
    ("CC-BY-NC-SA-4.0+", {"cc-by-nc-sa"}, 0.8),
    ("LicenseRef-own OR 0BSD", {"other", "bsd"}, 0.2),
    ("MIT and the text goes on", {"mit", "other"}, 0.5),
    ("MIT. And more", {"mit"}, 0.2),
    ("Apache-2.0 */ GPL-3.0", {"apache"}, 0.3),
    ("BSD-3-Clause\nGPL-3.0", {"bsd"}, 0.2),
    ("(MIT OR GPL-3.0", {"mit", "gpl"}, 0.6),  # open bracket: as if all held
    ("MIT) AND GPL-3.0", {"mit", "gpl"}, 0.6),
    ("OR MIT", {"mit"}, 0.2),
    ("", set(), 0.0),
    ("()", set(), 0.0),
    ("MIT OR", {"mit"}, 0.2),
])
def test_expressions(text, labels, score):
    assert value(text) == (labels, score)


def test_random_expressions_against_python(monkeypatch):
    """Bracketed by a recursive generator, which knows the value."""
    rng = random.Random(8)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(["MIT", "GPL-3.0", "CC-BY-4.0", "AGPL-3.0", "x"])
            level = licenses.LEVELS[licenses.label_of(name.lower())]
            return (f"{name} WITH e-1", min(level, licenses.EXCEPTION)) if rng.random() < 0.2 else (name, level)
        (a, x), (b, y) = made(depth - 1), made(depth - 1)
        return (f"({a} AND {b})", max(x, y)) if rng.random() < 0.5 else (f"({a} or {b})", min(x, y))

    for _ in range(500):
        text, want = made(5)
        assert value(text)[1] == want


def test_tags_in_texts():
    scan = licenses.Scanner().scan
    text = "# SPDX-License-Identifier: MIT OR GPL-2.0-only\nprint(1)"
    assert scan(text)[5:] == ("gpl,mit", 0.2)
    assert scan("License-Expression: (AGPL-3.0 AND MIT)\nAll rights reserved.")[1:] == (1, 7, 7, "reserved", "agpl,mit,reserved", 1.0)
    assert scan("spdx license identifier MIT")[5:] == ("", 0.0)
    assert scan("Licensed under CC BY-NC 4.0.")[1:] == (1, 2, 2, "cc-by", "cc-by,cc-by-nc", 0.8)


def test_odd_rows(docs_of):
    rows = [(1, None), (2, ""), (None, "All rights reserved"), (3, "cc by cc by"), (3, "cc by cc by"), (4, "x" * (1 << 21) + " CC\nBY"), (5, " - \x00")]
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["labels"], r["score"]) for r in licenses.scan(docs_of(rows)).collect()), key=str)
    assert got == [(0, 3, 1, 0, 0, "reserved", 1.0), (1, 0, 0, None, None, "", 0.0), (2, 0, 0, None, None, "", 0.0), (3, 4, 2, 0, 2, "cc-by", 0.3),
                   (3, 4, 2, 0, 2, "cc-by", 0.3), (4, 3, 1, 1, 1, "cc-by", 0.3), (5, 0, 0, None, None, "", 0.0)]
    assert licenses.scan(docs_of([])).count() == 0


def test_long_text_in_pieces():
    words = "lorem ipsum cc by dolor all rights reserved " * 200_000
    n, places, first, last, base, labels, score = licenses.Scanner().scan(words)
    assert (n, places, first, last, base, score) == (1_600_000, 400_000, 2, 1_599_997, "cc-by,reserved", 1.0)
