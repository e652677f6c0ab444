"""Line dedup against counting all lines at once."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelforge.llm import linededup

SCHEMA = "doc_id bigint, text string"


def key(line):
    return line.strip(linededup.SPACE).encode().lower().decode()


def brute(rows, least, shortest=1):
    counts = Counter()
    for _, text in rows:
        counts.update({k for k in map(key, (text or "").split("\n")) if len(k) >= shortest})
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if counts[key(x)] < least or len(key(x)) < shortest]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def texts(n):
    rng = random.Random(n)
    some = [f"Line {k} é" for k in range(60)] + ["LINE 3 é\r", "  line 3 é\t", "", " ", "\x0b", "É", "é", "ab", " wide ", "a "]
    rows = [(rng.choice([None, *range(50)]), "\n".join(rng.choices(some, weights=[1 + k % 7 for k in range(len(some))], k=rng.randrange(9)))) for _ in range(n)]
    return rows + [(1, None), (2, ""), (3, "\n\n"), (4, "Line 1 é\n" * 3), (5, "word " * 50_000 + "\nLine 2 é"), (5, "word " * 50_000 + "\nLine 2 é")]


def same(got, expected):
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=order) == sorted(expected, key=order)


@pytest.mark.parametrize("held", [3, 1 << 16])
def test_whole_texts_equal_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(linededup, "HELD", held)
    monkeypatch.setattr(linededup, "BITS", 1 << 16)
    rows = texts(150)
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "'x' as n", "2 as batch", "3 as asked")
    for least, shortest in ((10, 1), (4, 3)):
        got = linededup.drop_frequent_lines(docs, least, shortest, batches=4, fanout=2)
        same(got.select("doc_id", "text", "n_lines", "n_dropped").collect(), brute(rows, least, shortest))


def test_runs_are_levelled_and_know_what_is_frequent(spark):
    runs = linededup.LineRuns(spark, threshold=3, fanout=2, buckets=3)
    batch = lambda ks: spark.createDataFrame([(k.encode(), 1) for k in ks], "key binary, n bigint")
    assert runs.frequent().count() == 0
    held = []
    for ks in ("abc", "abd", "ae", "af", "ag"):
        held.append(sorted(bytes(r.key).decode() for r in runs.unknown(batch(ks)).collect()))
        runs.add(batch(ks))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    # a's third document is seen when the first four runs are one
    assert held == [["a", "b", "c"], ["a", "b", "d"], ["a", "e"], ["a", "f"], ["g"]]
    assert [(bytes(r.key), r.n) for r in runs.frequent().collect()] == [(b"a", 4)]
    sorted_runs = [[bytes(r.key) for r in spark.table(x).filter(F.input_file_name() == f).collect()] for x in runs.runs() for f in {r[0] for r in spark.table(x).select(F.input_file_name()).collect()}]
    assert all(x == sorted(x) for x in sorted_runs)
    runs.drop()
    assert runs.runs() == []


def test_empty_table(spark):
    assert linededup.drop_frequent_lines(spark.createDataFrame([], SCHEMA)).count() == 0
