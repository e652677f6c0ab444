"""Operators that return the rows of documents: no column name clashes with their own, and code points equal the library's."""

import struct

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from panelforge.llm import dedup, mixing, near, tokens

CLASH = ["row", "i", "t", "label", "h", "kept_id", "kept_text", "near_id", "near_text", "_kept_id", "_kept_text", "_near_id", "_near_text", "_text_sha256", "_mix_w", "_mix_k", "_mix_r", "_mix_p", "_mix_t", "_mix_f", "_mix_text", "_mix_n", "a.b", "no_id"]


def clashing(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    return docs.select("*", *(F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in CLASH))


def values(df):
    return {tuple(r) for r in df.collect()}


def test_values_of_clashing_columns_stay(spark):
    long = " ".join(f"word{k}" for k in range(60))
    docs = clashing(spark, [long, long + " more", long, "other words stand here alone", None, ""])
    rows = {r.doc_id: tuple(r) for r in docs.collect()}
    assert values(dedup.drop_copies(docs)) == {rows[k] for k in (0, 1, 3, 4)}
    assert values(near.keep_one_of_each(docs)) == {rows[k] for k in (0, 3, 4, 5)}
    labels = spark.createDataFrame([(0, "good"), (3, "bad")], "doc_id bigint, domain string")
    mix = mixing.fit_mixture(docs, labels, {"good": 0.5, "bad": 0.5}, least=1.0)
    out = mixing.apply_rates(docs, mix)
    assert out.columns == docs.columns and values(out) == set(rows.values())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_every_code_point_before_a_contraction(library):
    enc = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    odd = [c for c in every if enc.unproved.search(c)]
    assert 1000 < len(odd) < 100_000
    proved = [c for c in every if not enc.unproved.search(c)]
    texts = ["".join(f"x{c}'s{c}'ll {c}1{c}" for c in proved[k : k + 500]) for k in range(0, len(proved), 500)]
    texts += [f"x{c}'s{c}'ll {c}1" for c in odd[::7]]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert enc.encode(t) == struct.pack(f"<{len(e.ids)}I", *e.ids)


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        told = json.load(f)
    for k, change in enumerate(({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": told["pre_tokenizer"] | {"add_prefix_space": True}})):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(told | change), encoding="utf-8")
        with pytest.raises(ValueError, match=next(iter(change))):
            tokens.Encoder(str(path))


def test_the_pipeline_takes_toxic_null_and_no_rows(spark, tmp_path):
    bad, good = "vile slur insult hate filth", "calm garden morning bread river"
    rows = [(i, " ".join((bad if i % 3 == 0 else good).split()[(i + k) % 5] for k in range(40)) + f" {i}" * 6, "en", "src0", 5) for i in range(90)]
    rows += [(None, None, None, None, None), (200, "", "en", None, 0), (None, rows[1][1], "en", "src1", 5)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    labels = [(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(90)]
    for name, some in (("whole", rows), ("none", [])):
        at = str(tmp_path / name)
        spark.createDataFrame(some, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(labels if some else [], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        got = corpus_pipeline.run(spark, at).collect()
        kept = {r.doc_id for r in got}
        if some:
            clean = {i for i in range(90) if i % 3}
            assert len(kept & {i for i in range(90) if i % 3 == 0}) <= 3 and len(clean - kept) <= 6
        else:
            assert got == []
