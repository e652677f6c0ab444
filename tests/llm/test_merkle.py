"""Merkle manifest against trees built one after the other."""

import hashlib
import random
import string
import zlib
from collections import defaultdict

from panelforge.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    """(root, for each leaf the (left, right) siblings of each level)."""
    paths, at = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, places = [], []
        for b in range(0, len(nodes), 16):
            run = nodes[b : b + 16]
            for k in range(len(run)):
                for leaf_at in at[b + k]:
                    paths[leaf_at].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha(*run))
            places.append([x for k in range(len(run)) for x in at[b + k]])
        nodes, at = above, places
    return nodes[0], paths


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        h = leaf(doc_id, source, lang, n_chars, text)
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        other = leaf(doc_id, source, lang, n_chars, text.translate(LOWER) if hit and text is not None else text)
        groups[source].append((doc_id, h, other))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in sources:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        built[s] = climb([h for _, h, _ in groups[s]])
    root, ups = climb([built[s][0] for s in sources])
    out = []
    for s, up in zip(sources, ups, strict=True):
        subroot, paths = built[s]
        for (doc_id, h, other), own in zip(groups[s], paths, strict=True):
            path, y = own + up, other
            for left, right in path:
                y = sha(left, y, right)
            out.append((doc_id, h, subroot, root, sha(*[x for step in path for x in step]), y, y == root))
    return out


def check(spark, rows, extra=False):
    docs = spark.createDataFrame(rows, SCHEMA)
    if extra:
        docs = docs.selectExpr("*", "1 as i", "2 as n", "'x' as h", "3 as g", "'y' as path", "4 as subroot", "5 as root")
    got = merkle.manifest(docs, tampered={"text": merkle.lowered_fifth(docs)}).collect()
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted([tuple(r) for r in got], key=key) == sorted(brute(rows), key=key)
    return got


def test_trees_of_all_heights(spark):
    rng = random.Random(1)
    sizes = {"a": 1, "b": 2, "c": 16, "d": 17, "e": 256, "f": 290, "é": 33, "Z": 15, None: 40, "": 3}
    rows = [(rng.randrange(10**6), rng.choice(["Some Text", "lower only", "", None, "ÄÖ Umlaut"]), rng.choice(["en", None]), s, rng.choice([None, 3])) for s, n in sizes.items() for _ in range(n)]
    rng.shuffle(rows)
    got = check(spark, rows, extra=True)
    assert {r.verified for r in got} == {True, False}
    assert all(r.verified or zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)


def test_many_sources_nulls_and_repeats(spark):
    rows = [(i, f"Text {i}", "en", f"s{i}", 5) for i in range(40)] + [(None, "A", "en", "s1", 1)] * 2 + [(7, "Same", "de", "s2", 4)] * 20 + [(7, "Other", "de", "s2", 5)]
    check(spark, rows + [(99, "Word " * 100_000, None, None, None)])


def test_one_row_and_none(spark):
    (r,) = check(spark, [(3, "Only", "en", "s", 4)])
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha("")
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
