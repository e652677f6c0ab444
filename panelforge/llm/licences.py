"""Licence scans: Aho-Corasick over words and tags, a shunting-yard parser for expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text

#: Phrases whose places are counted, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases of the method.
NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons": "cc",
    "cc by": "cc",
    "cc0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "reserved",
}
TAG = "spdx-license-identifier:"
#: Identifier prefix -> family, longest prefix first when sought.
FAMILIES = {"mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "mpl": "mpl", "epl": "epl", "isc": "isc", "bsl": "bsl", "cc0": "cc0", "cc": "cc", "unlicense": "public-domain"}
PERMISSIVE = {"mit", "apache", "bsd", "isc", "bsl", "cc0", "public-domain"}
RANK = {"or": 1, "and": 2, "with": 3}

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TOKEN = re.compile(r"[()]|[a-z0-9.+-]+")


def postfix(expression: str) -> list[str] | None:
    """A licence expression in postfix order by the shunting-yard algorithm; None if malformed.

    with binds before and, and before or; all are left-associative.
    """
    out: list[str] = []
    held: list[str] = []
    operand = False
    for t in _TOKEN.findall(expression.lower()):
        if t in RANK:
            if not operand:
                return None
            while held and held[-1] != "(" and RANK[held[-1]] >= RANK[t]:
                out.append(held.pop())
            held.append(t)
            operand = False
        elif t == "(":
            if operand:
                return None
            held.append(t)
        elif t == ")":
            if not operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        else:
            if operand:
                break  # prose after a complete expression
            out.append(t)
            operand = True
    if not operand:
        return None
    while held:
        if held[-1] == "(":
            return None
        out.append(held.pop())
    return out


#: Identifiers that the shape of an identifier, a digit or a hyphen, doesn't show.
PLAIN = frozenset("mit apache gpl lgpl agpl bsd mpl epl isc bsl cc0 unlicense zlib libpng openssl postgresql python ruby php perl artistic ncsa wtfpl beerware vim curl json x11 zend intel sleepycat".split())


def is_identifier(token: str) -> bool:
    """Whether a token names a licence: a known name, or one with a digit or a hyphen within, as prose has few of."""
    return token in PLAIN or token[0].isalnum() and token[-1] not in ".-" and any(c.isdigit() or c == "-" for c in token) and any(c.isalpha() for c in token)


def leading(line: str) -> str:
    """The longest part at a line's beginning that is a well-formed expression of identifiers; prose after it, and operators in prose, don't count. An exception, after with, may have any name."""
    tokens = _TOKEN.findall(line.lower())
    for k, t in enumerate(tokens):
        if t.endswith("."):  # a sentence ends, and the expression with it
            tokens[k:] = [t.rstrip(".")] * (t.strip(".") != "")
            break
    best = depth = 0
    operand = False
    for k, t in enumerate(tokens):
        if t in RANK or t == ")":
            if not operand or t == ")" and not depth:
                break
            depth -= t == ")"
            operand = t == ")"
        elif operand or t != "(" and not (is_identifier(t) or k and tokens[k - 1] == "with"):
            break
        else:
            depth += t == "("
            operand = t != "("
        if operand and not depth:
            best = k + 1
    return " ".join(tokens[:best])


def family(identifier: str) -> str:
    """The label of an identifier: its family, or itself where that is unknown."""
    known = [f for f in FAMILIES if identifier == f or identifier.startswith(f"{f}-")]
    return FAMILIES[max(known, key=len)] if known else identifier


def evaluate(post: list[str]) -> tuple[set[str], bool]:
    """Labels of all licences named, and whether a user may choose permissive terms throughout."""
    stack: list[tuple[set[str], bool]] = []
    for t in post:
        if t in RANK:
            (b, y), (a, x) = stack.pop(), stack.pop()
            # an exception names no licence and only loosens the one before it
            stack.append((a, x) if t == "with" else (a | b, x or y) if t == "or" else (a | b, x and y))
        else:
            f = family(t)
            stack.append(({f}, f in PERMISSIVE))
    return stack[-1]


@lru_cache(maxsize=1)
def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in (NOTICES | BASE).items():
        phrases.add_word(f" {phrase} ", (phrase, label, phrase.count(" ") + 1, phrase in BASE))
    tags.add_word(TAG, TAG)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one whole text."""
    raw = (text or "").encode()
    words = raw.translate(_WORDS).split()
    phrases, tags = automata()
    line = b" ".join(words).join((b" ", b" ")).decode("latin-1")  # one character a byte
    base: list[int] = []
    base_labels: set[str] = set()
    labels: set[str] = set()
    doubt = 1.0
    at = words_before = 0
    for end, (phrase, label, size, is_base) in phrases.iter(line):
        words_before += line.count(" ", at, end)  # blanks before the phrase's last one
        at = end
        labels.add(label)
        doubt *= 0.4 if is_base else 0.5
        if is_base:
            base.append(words_before - size)
            base_labels.add(label)
    if b"spdx" in (low := raw.translate(_LOWER)):
        low_text = low.decode()
        for end, _ in tags.iter(low_text):
            stop = low_text.find("\n", end)
            post = postfix(leading(low_text[end + 1 : stop if stop >= 0 else len(low_text)]))
            if post:
                named, free = evaluate(post)
                labels |= named | ({"permissive"} if free else set())
                doubt *= 0.1
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1 - doubt


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every whole text.

    Words, base phrases and labels: see `scan`. `score` is the weight of evidence for a licence
    statement: 1 - product of 0.4 for each base place, 0.5 for each other notice, 0.1 for each
    tag with a well-formed expression, of which the longest part counts (see `leading`). Null counts as empty: 0 words, no labels, score 0; repeated rows are scanned each, other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = pd.DataFrame(list(map(scan, b["text"])), columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
            found.insert(0, "doc_id", b["doc_id"].values)
            yield found.astype({"first_word": "Int64", "last_word": "Int64"})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, kind = as_text(rows, "doc_id")
    scanned = rows.mapInPandas(run, "doc_id string, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
    return scanned.withColumn("doc_id", F.col("doc_id").cast(kind))
