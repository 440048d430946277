"""Licence scans: notices by an Aho-Corasick automaton, identifier expressions by a shunting yard.

The words of a text, one blank between, run once through an automaton of all notice
phrases; every place where a phrase's words stand consecutively counts, also inside a
longer phrase.  Where the words of an identifier tag occur, the text itself is searched
for the tags by a second automaton, and the expression behind each is parsed: `with`
binds closer than `and`, `and` closer than `or`, brackets group.  An expression ends
with its line, at a sign that none can hold, or where an identifier follows another.

score says how much a text's licences restrict its use: 0 without any sign of one, 1
with all rights reserved.  All notices of a text hold at once, so the strictest counts.
In an expression `and` takes the stricter side, `or` the freer one (the user may choose),
and an exception (`with`) loosens its licence to EXCEPTION at most.  What doesn't parse
is taken as if all its identifiers were joined by `and`.

Nulls: a null or empty text has no words, no labels and score 0.  Long texts are taken
in pieces; phrases across their ends are found.  Rows that repeat are scanned one by
one, a null doc_id like any other, an empty table gives no rows.  Other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystead.llm.common import LOWER, UPPER, slices, text_chunks, text_or_empty

# Fixed values of the contract: what separates words, and the base phrases with their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Further notices with their labels.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "free documentation license": "gfdl",
    "open database license": "odbl",
    "released into the public domain": "public-domain",
    "dedicated to the public domain": "public-domain",
    "cc0 1 0": "cc0",
    "creative commons zero": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noncommercial": "cc-by-nc",
    "proprietary and confidential": "proprietary",
    "unauthorized copying": "proprietary",
}

# Identifier tags, and their words.
TAGS = ("spdx-license-identifier:", "license-expression:")
TAG_WORDS = ("spdx license identifier", "license expression")

# How much a label restricts use.
LEVELS = {
    "cc0": 0.1, "public-domain": 0.1, "bsd": 0.2, "bsl": 0.2, "isc": 0.2, "mit": 0.2, "apache": 0.3, "cc-by": 0.3,
    "cc-by-sa": 0.5, "epl": 0.5, "lgpl": 0.5, "mpl": 0.5, "odbl": 0.5, "other": 0.5, "gfdl": 0.6, "gpl": 0.6, "agpl": 0.7,
    "cc-by-nd": 0.7, "cc-by-nc": 0.8, "cc-by-nc-sa": 0.8, "cc-by-nc-nd": 0.9, "proprietary": 1.0, "reserved": 1.0,
}
EXCEPTION = 0.4
# Identifiers that don't begin with their label.
ALIASES = {"0bsd": "bsd", "unlicense": "public-domain", "none": "reserved"}

STRENGTH = {"or": 1, "and": 2, "with": 3}
_separators = re.compile(SEPARATORS)
_tokens = re.compile(r"[ \t]*([()]|[a-z0-9.+:-]+)")
_lower = str.maketrans(UPPER, LOWER)


def label_of(identifier: str) -> str:
    """The label of an identifier in lower case: the longest that it begins with."""
    name = ALIASES.get(identifier.rstrip("+"), identifier.rstrip("+"))
    parts = name.split("-")
    for n in range(len(parts), 0, -1):
        if "-".join(parts[:n]) in LEVELS:
            return "-".join(parts[:n])
    return "other"


def expression_tokens(text: str, at: int) -> list[str]:
    """The tokens of the expression that begins at a place of a lower-case text."""
    found: list[str] = []
    while token := _tokens.match(text, at):
        word = token[1].rstrip(".:") or token[1]
        operand = word not in STRENGTH and word not in "()"
        if found and (operand or word == "(") and (found[-1] == ")" or found[-1] not in STRENGTH and found[-1] != "("):
            break
        found.append(word)
        at = token.end()
        if word != token[1]:
            break
    while found and found[-1] in STRENGTH:
        found.pop()
    return found


def postfix(tokens: list[str]) -> list[str]:
    """The tokens in postfix order, by a shunting yard; ValueError if brackets or operands don't fit."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in tokens:
        if token == "(":
            if not operand_next:
                raise ValueError(token)
            waiting.append(token)
        elif token == ")":
            if operand_next:
                raise ValueError(token)
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ValueError(token)
            waiting.pop()
        elif token in STRENGTH:
            if operand_next:
                raise ValueError(token)
            while waiting and STRENGTH.get(waiting[-1], 0) >= STRENGTH[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        else:
            if not operand_next:
                raise ValueError(token)
            out.append(token)
            operand_next = False
    if operand_next or "(" in waiting:
        raise ValueError("end")
    return out + waiting[::-1]


def evaluated(tokens: list[str]) -> tuple[set[str], float]:
    """The labels of an expression and how much it restricts use."""
    names = [t for i, t in enumerate(tokens) if t not in STRENGTH and t not in "()" and not (i and tokens[i - 1] == "with")]
    labels = {label_of(n) for n in names}
    try:
        stack: list[float] = []
        order = postfix(tokens)
        for token in order:
            if token not in STRENGTH:
                stack.append(LEVELS[label_of(token)])
                continue
            right, left = stack.pop(), stack.pop()
            stack.append(min(left, right) if token == "or" else max(left, right) if token == "and" else min(left, EXCEPTION))
        return labels, stack[0]
    except ValueError:
        return labels, max((LEVELS[x] for x in labels), default=0.0)


def phrase_automaton() -> ahocorasick.Automaton:
    """Phrases between blanks; a value is (number of words, label or None for a tag, is it base)."""
    out = ahocorasick.Automaton()
    for phrases, base in ((NOTICES, False), (dict.fromkeys(TAG_WORDS), False), (BASE, True)):
        for phrase, label in phrases.items():
            out.add_word(f" {phrase} ", (phrase.count(" ") + 1, label, base))
    out.make_automaton()
    return out


def tag_automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for tag in TAGS:
        out.add_word(tag, tag)
    out.make_automaton()
    return out


LONGEST = max(p.count(" ") + 1 for p in (*BASE, *NOTICES, *TAG_WORDS))


class Scanner:
    """Scans texts one after another; built once a task."""

    def __init__(self):
        self.phrases, self.tags = phrase_automaton(), tag_automaton()

    def scan(self, text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        n_words, carry, tagged = 0, "", False
        starts: list[int] = []
        base: set[str] = set()
        labels: set[str] = set()
        for piece in text_chunks(text):
            own = _separators.sub(" ", piece.translate(_lower)).strip(" ")
            if not own:
                continue
            line = f" {carry} {own} " if carry else f" {own} "
            before = len(carry) + 1 if carry else 0  # matches that end there have been seen
            behind, counted, spaces = n_words - (carry.count(" ") + 1 if carry else 0), 0, 0
            for end, (size, label, is_base) in self.phrases.iter(line):
                if end <= before:
                    continue
                if label is None:
                    tagged = True
                    continue
                labels.add(label)
                if is_base:
                    spaces += line.count(" ", counted, end + 1)
                    counted = end + 1
                    base.add(label)
                    starts.append(behind + spaces - 1 - size)
            n_words += own.count(" ") + 1
            carry = " ".join(line[1:-1].rsplit(" ", LONGEST)[-LONGEST:])
        score = max((LEVELS[x] for x in labels), default=0.0)
        if tagged:
            lower = text.translate(_lower)
            for end, _ in self.tags.iter(lower):
                more, value = evaluated(expression_tokens(lower, end + 1))
                labels |= more
                score = max(score, value)
        first, last = (min(starts), max(starts)) if starts else (None, None)
        return n_words, len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


KIND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of (doc_id, text)."""
    names = [part.split()[0] for part in KIND.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in slices(batches):
            columns = list(zip(*map(scanner.scan, batch.column(1).to_pylist()))) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds[1:]))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(work, KIND)
