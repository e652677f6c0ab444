"""Token counts with a whole-token shortcut.

A byte-level BPE tokenizer cuts a text into pre-tokens and merges each pre-token alone. A
vocabulary string that the library turns into exactly one token when encoded alone needs no
merging wherever it stands as a pre-token. `whole_tokens` proves this for every vocabulary
string with the library itself; `Encoder` then looks pre-tokens up and sends only the rest to
the library, once for each different pre-token.

Pre-tokens are cut by a pattern of letters, numbers and white space, of which the library and
Python may know different versions of Unicode. `unproved` asks the library about every code
point; a text with one that it classes otherwise goes to the library as a whole.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import as_text

# The pre-token pattern of the byte-level vocabulary, for Python's own `re`, where a text has
# only characters of Latin-1: there \p{L} is A-Z a-z and the letters below, \p{N} 0-9 and ²³¹¼½¾.
_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_N = "0-9²³¹¼-¾"
# White space as the Unicode property has it; Python's \s also holds \x1c-\x1f.
_S = "\t-\r \u0085 "
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

DEFAULT_TOKENIZER = "byte_bpe_50k.json"


@lru_cache(maxsize=4)
def load_tokenizer(path: str) -> Tokenizer:
    """The library's tokenizer without truncation or padding."""
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def require_byte_level(path: str) -> None:
    """Raise unless the file is a byte-level BPE that this module's cuts and merges are right for."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, cut = told["model"], told.get("pre_tokenizer") or {}
    right = {
        "model": model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
        "pre_tokenizer": cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True),
        "normalizer": told.get("normalizer") is None,
    }
    if wrong := [k for k, ok in right.items() if not ok]:
        raise ValueError(f"{path}: no plain byte-level BPE, see its {', '.join(wrong)}")


#: A sign of each class of the pattern; more of its class make one pre-token with it.
_CLASSES = {"letters": "a", "numbers": "1", "space": "\t", "others": "!"}


def _run_classes(first: int, stop: int) -> Iterator[tuple[str, str]]:
    """(class, run) of consecutive code points, as this module's patterns class them."""
    text = "".join(map(chr, (c for c in range(first, stop) if not 0xD800 <= c < 0xE000)))
    pattern = regex.compile(r"(?P<letters>\p{L}+)|(?P<numbers>\p{N}+)|(?P<space>\s+)|(?P<others>[^\s\p{L}\p{N}]+)")
    latin = re.compile(f"(?P<letters>[{_L}]+)|(?P<numbers>[{_N}]+)|(?P<space>[{_S}]+)|(?P<others>[^{_S}{_L}{_N}]+)")
    for m in (latin if stop <= 256 else pattern).finditer(text):
        yield m.lastgroup, m.group()


def _disagreeing(pre, first: int, stop: int) -> Iterator[str]:
    """Code points that the library's pre-tokenizer classes otherwise; runs are halved until they agree."""
    for kind, run in _run_classes(first, stop):
        parts = [run[k : k + 4096] for k in range(0, len(run), 4096)]
        while parts:
            part = parts.pop()
            if len(pre.pre_tokenize_str(_CLASSES[kind] + part)) > 1:
                if len(part) == 1:
                    yield part
                else:
                    parts += [part[: len(part) // 2], part[len(part) // 2 :]]


@lru_cache(maxsize=4)
def unproved(path: str) -> re.Pattern:
    """Finds a code point that this module and the library class differently, anywhere in Unicode."""
    pre = load_tokenizer(path).pre_tokenizer
    if odd := list(_disagreeing(pre, 0, 256)):
        raise ValueError(f"{path}: the library classes {odd!r} of Latin-1 otherwise")
    found = sorted(map(ord, _disagreeing(pre, 0, 0x110000)))
    spans: list[list[int]] = []
    for c in found:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in spans) + "]" if spans else "(?!)")


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> dict[str, bytes]:
    """Vocabulary strings that encode alone as exactly their own token, with that id's four bytes."""
    tok = load_tokenizer(path)
    ids = sorted(tok.get_vocab().values())
    texts = tok.decode_batch([[i] for i in ids], skip_special_tokens=False)
    proved = {}
    for i, text, enc in zip(ids, texts, tok.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        if enc.ids == [i]:
            proved[text] = np.uint32(i).tobytes()
    for special in specials(path):
        proved.pop(special, None)
    return proved


@lru_cache(maxsize=4)
def specials(path: str) -> tuple[str, ...]:
    """Strings that the library takes out of a text before it cuts pre-tokens."""
    return tuple(t.content for t in load_tokenizer(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=2)
def merger(path: str) -> tiktoken.Encoding | None:
    """The same vocabulary as byte ranks, or None where the merges don't stand in the order of their ids.

    Where they do, merging by ranks equals the library's merging, and costs a fifth of the time.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:])):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    ranks = {bytes(map(byte_of.__getitem__, s)): i for s, i in vocab.items() if s not in specials(path)}
    return tiktoken.Encoding("ranks", pat_str=_ANY.pattern, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of texts, equal to those of the library.

    `memory` bounds how many merged pre-tokens one worker remembers; it changes no result.
    """

    def __init__(self, path: str, memory: int = 100_000):
        self.tok, self.whole, self.specials, self.memory = load_tokenizer(path), whole_tokens(path), specials(path), memory
        require_byte_level(path)
        self.ranks, self.unproved = merger(path), unproved(path)
        self.known: dict[str, bytes] = dict(self.whole)

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens of a text without special strings; None for the library to cut it."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None if self.unproved.search(text) else _ANY.findall(text)
        return _LATIN.findall(text)

    def _whole(self, text: str) -> bytes:
        ids = self.tok.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def merge(self, piece: str) -> bytes:
        """Merge one pre-token that is no whole token, and remember it."""
        ids = self.ranks.encode_ordinary(piece) if self.ranks else self.tok.encode(piece, add_special_tokens=False).ids
        if len(self.known) >= len(self.whole) + self.memory:
            self.known = dict(self.whole)
        self.known[piece] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, text: str | None) -> bytes:
        """A text's ids as unsigned little-endian 32-bit numbers."""
        if not text:
            return b""
        if any(s in text for s in self.specials):
            return self._whole(text)
        pieces = self.pieces(text)
        if pieces is None:
            return self._whole(text)
        found = list(map(self.known.get, pieces))
        if None in found:
            found = [f if f is not None else self.known.get(p) or self.merge(p) for p, f in zip(pieces, found, strict=True)]
        return b"".join(found)  # type: ignore[arg-type]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every whole text: (doc_id, n_bytes, n_tokens, over_limit).

    `tokenizer`: path of a byte-level BPE file of the `tokenizers` library, on every executor;
    a file with another model, a normaliser or another cut raises.
    Null texts count as empty: 0 bytes, 0 tokens. A null id and repeated rows stay as they are;
    other columns are not read; an empty table gives no rows. No shuffle; memory is bounded by
    an Arrow batch and by the encoder's memory.
    """
    path = tokenizer or public_tokenizers.path(DEFAULT_TOKENIZER)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            texts = b["text"].tolist()
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": [len(enc.encode(t)) // 4 for t in texts]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, kind = as_text(rows, "doc_id")
    counted = rows.mapInPandas(run, "doc_id string, n_bytes bigint, n_tokens bigint")
    return counted.withColumns({"doc_id": F.col("doc_id").cast(kind), "over_limit": F.col("n_tokens") > limit})
