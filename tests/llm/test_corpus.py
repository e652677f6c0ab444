"""Corpus operators against brute force, on small and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelforge.llm import dedup, licences, mixing, near, packing, pages, quality, tokens, topk, toxicity
from panelforge.llm.shingles import shingle_set

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 40_000 + "x" * 200_000


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " ", "\n", "a", "A  b\tC", "a b c", "Ünïcode ñ 日本 🙂 <|endoftext|> x", "it's we'll 123 ²\x1c\x85", LONG, LONG, "a b c"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_whole_tokens_are_proved(library):
    proved = tokens.whole_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    some = random.Random(1).sample(sorted(proved), 500)
    assert all(np.frombuffer(proved[s], np.uint32).tolist() == library.encode(s, add_special_tokens=False).ids for s in some)
    assert len(proved) > 49_000 and "<|endoftext|>" not in proved


def test_token_counts_equal_the_library(spark, library):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices([chr(c) for c in range(0x300)] + [" ", "\n", "'s"] * 50, k=40)) for _ in range(300)]
    got = tokens.count_tokens(frame(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((t or "").encode()), n, n > 1024)


def test_packing_is_an_exact_round_trip(spark, library):
    got = defaultdict(list)
    for r in packing.pack_power_of_two(frame(spark, ODD), with_ids=True).collect():
        assert r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0 and zlib.crc32(r.ids) == r.ids_crc32
        got[r.doc_id].append(r)
    assert len({r.sequence_id for rs in got.values() for r in rs}) == sum(map(len, got.values()))
    for i, t in enumerate(ODD):
        parts = sorted(got[i], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in parts), np.uint32).tolist()
        assert ids == [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert [r.start for r in parts] == list(np.cumsum([0, *(r.length for r in parts)])[:-1]) and parts[0].doc_tokens == len(ids)


def test_cuckoo_index_inserts_deletes_and_grows():
    index, live, rng = dedup.CuckooIndex(2), {}, random.Random(3)
    for _ in range(20_000):
        d = hashlib.sha256(str(rng.randrange(3000)).encode()).digest()
        if rng.random() < 0.6:
            assert index.insert(d, 1) == (d not in live)
            live[d] = live.get(d, 0) + 1
        else:
            assert index.delete(d) == (d in live)
            if d in live:
                live[d] -= 1
                if not live[d]:
                    del live[d]
    assert {d: n for d, _, n in index.entries()} == live and index.resizes > 0
    assert all(index.find(d) for d in live) and index.size == len(live)


def test_exact_dedup_brute_force(spark):
    texts = ODD + ["a b  c", " a b c", "a b c"]
    ids = [*range(5, 5 + len(texts) - 1), 2]
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for t in texts]
    groups = defaultdict(list)
    for i, n in zip(ids, norm, strict=True):
        groups[n].append(i)
    want = {i: (min(groups[n]), len(groups[n]), min(groups[n]) == i, hashlib.sha256(n.encode()).hexdigest()) for i, n in zip(ids, norm, strict=True)}
    docs = frame(spark, texts, ids).withColumnRenamed("source", "digest")
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in dedup.exact_dedup(docs).collect()} == want
    kept = dedup.drop_copies(docs.union(docs))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, w in want.items() if w[2])


def test_index_updates(spark):
    e = lambda *x: spark.createDataFrame([(dedup.digest_of(t), i, 1) for t, i in x], "digest binary, doc_id bigint, n_rows bigint")
    index = dedup.digest_index(e(("a", 1), ("a", 2), ("b", 3)))
    new = dedup.update_index(index, e(("c", 4)), e(("b", 3), ("zz", 9), ("a", 1)))
    assert {(bytes(r.digest), r.doc_id, r.n_rows) for r in new.collect()} == {(dedup.digest_of("a"), 1, 1), (dedup.digest_of("c"), 4, 1)}


def brute_components(ids, texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, d in enumerate(ids)}


def test_jaccard_components_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"W{k}" for k in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 5, 8, 9, 14, 20, 60, 150]))] for _ in range(25)]
    texts = list(ODD)
    for b in base * 6:
        w = list(b)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w + rng.choices(vocab, k=rng.randrange(3))))
    ids = rng.sample(range(1000), len(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.jaccard_components(frame(spark, texts, ids)).collect()}
    assert got == brute_components(ids, texts)
    one = near.keep_one_of_each(frame(spark, texts, ids))
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, c in got.values()})


def test_one_row_of_each_class_stays_though_ids_repeat(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    docs = frame(spark, [text, text + " more", "quite another text that has words", text + " less", text, text], [1, 2, 2, None, 1, 3])
    left = Counter((r.doc_id, r.text) for r in near.keep_one_of_each(docs.withColumnRenamed("source", "label")).collect())
    assert left == Counter([(1, text), (1, text), (2, "quite another text that has words")])


def test_shingles_of_a_very_long_word():
    assert len(shingle_set("x" * 200_000 + " a b c d e")) == 2
    assert shingle_set("x" * 200_000 + " b")[0] != shingle_set("x" * 199_999 + "y b")[0]
    assert np.array_equal(shingle_set("A b\tc"), shingle_set(" a B c\n"))


def test_light_sets_share_a_subset_and_heavy_ones_a_kept_entry():
    s, rng = near.Sizes(80), random.Random(5)
    for _ in range(300):
        n = rng.randrange(4, 120)
        a = rng.sample(range(10_000), n)
        b = [x for x in a if rng.random() > 0.1] + rng.sample(range(10_000, 20_000), rng.randrange(1 + n // 10))
        if 100 * len(set(a) & set(b)) < 80 * len(set(a) | set(b)) or min(len(a), len(b)) < 4 or set(a) == set(b):
            continue
        x, y = (np.sort(np.array([int(hashlib.md5(str(v).encode()).hexdigest()[:15], 16) for v in q], np.uint64)) for q in (a, b))
        assert len(np.intersect1d(near.light_keys(x, s), near.light_keys(y, s)))
        length = Counter(v for q in (x, y) for v in q[: s.listed(len(q))].tolist())
        keep = [set(sorted(q[: s.listed(len(q))].tolist(), key=lambda v: (length[v], v))[: s.kept(len(q))]) for q in (x, y)]
        assert keep[0] & keep[1]


def test_licences(spark):
    text = "Under the MIT-License, or the Apache  license; GNU General Public\nLicense.\nSPDX-License-Identifier: (MIT OR GPL-2.0 WITH x) AND Apache-2.0\n"
    r = licences.licence_scan(frame(spark, [text, None, "mit", "mit license mit license"])).orderBy("doc_id").collect()
    assert (r[0].n_base, r[0].first_word, r[0].last_word, r[0].base_labels) == (3, 2, 9, "apache,gpl,mit")
    assert "permissive" in r[0].labels.split(",") and 0.9 < r[0].score <= 1
    assert tuple(r[1])[1:] == (0, 0, None, None, "", "", 0.0) and r[2].n_base == 0 and (r[3].n_base, r[3].last_word) == (2, 2)
    assert licences.postfix("a or b and (c or d)") == ["a", "b", "c", "d", "or", "and", "or"]
    assert licences.postfix("a or") is None and licences.postfix("(a") is None and licences.postfix("") is None
    assert licences.evaluate(licences.postfix("gpl-3.0 or mit")) == ({"gpl", "mit"}, True)


def test_base_places_brute_force(spark):
    rng = random.Random(6)
    parts = ["mit", "License", "apache", "general", "PUBLIC", "x", "é"]
    texts = [rng.choice(["", "-"]).join(rng.choice(parts) + rng.choice([" ", "/", "\n", "."]) for _ in range(60)) for _ in range(50)]
    for r, t in zip(licences.licence_scan(frame(spark, texts)).orderBy("doc_id").collect(), texts, strict=True):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = [i for p in licences.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))


def test_top_k_brute_force(spark):
    rng = np.random.default_rng(7)
    vecs = [(i, [float(x) for x in np.round(rng.normal(size=8), 1)]) for i in range(120)] + [(200, None), (201, [1.0, None]), (202, [float("nan")] * 8), (203, [float("inf")] * 8), (204, [])]
    df = spark.createDataFrame(vecs, "vec_id bigint, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k_inner(df.filter("vec_id % 50 = 0"), df, 5, query_block=2, row_block=7).collect()}
    q = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vecs[:120]}
    q[204] = np.zeros(8, int)
    for i in (0, 50, 100):
        order = sorted(((-int(q[i] @ w), j) for j, w in q.items() if j != i))[:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, -s) for s, j in order]
    few = topk.top_k_inner(df.filter("vec_id = 0"), df.filter("vec_id < 3"), 5)
    assert few.count() == 2 and topk.top_k_inner(df.limit(0), df, 5).count() == 0


HTML = '<html><head><title>t</title></head><body><nav><a>Menu</a></nav><div class="x">{box}</div><article><h1>H &amp; {n}</h1><p>one\n two<p>Same paragraph<br>here</article><div class="comments"><p>c</p></div><footer>f</footer></body></html>'


def test_pages(spark):
    rows = [(i, f"http://h.com/{i}", HTML.format(box="Box", n=i)) for i in range(12)] + [(20, None, None), (21, "x", ""), (22, "http://h.com/z", "<p>a<b>b</b> c<p>d&lt;")]
    got = {r.page_id: (r.text, r.n_chars) for r in pages.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[3][0] == "H & 3\none two\nSame paragraph here" and got[20] == ("", 0) and got[21] == ("", 0) and got[22][0] == "ab c\nd<"


def test_templates_without_an_article(spark):
    rows = [(i, f"http://h.com/{i}", f"<body><div>Welcome to us</div><div><p>text {i}</p></div></body>") for i in range(12)] + [(50, "http://other.com/", "<body><div>Welcome to us</div></body>")]
    got = {r.page_id: r.text for r in pages.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[4] == "text 4" and got[50] == "Welcome to us"


PATH = public_tokenizers.path("byte_bpe_50k.json")


def _bigram_model(docs, n):
    counts = quality.bigram_counts(quality.trusted_texts(docs, docs.filter(f"doc_id < {n}").select("doc_id")), PATH).cache()
    return counts, quality.backoff(counts, quality.vocabulary(PATH))


def test_kneser_ney_sums_to_one(spark):
    docs = frame(spark, ["the cat sat on the mat", "the dog sat", None, ""])
    counts, kept = _bigram_model(docs, 4)
    size = len(kept.p1)
    leave, name = kept.costs()
    seen = counts.toPandas()
    the, unseen = (tokens.encoder(PATH).encode(t) for t in (" the", " Zürich"))
    for v in (size - 1, int(np.frombuffer(the, np.uint32)[0]), int(np.frombuffer(unseen, np.uint32)[0])):
        cost = leave[v] + name
        own = seen[seen["v"] == v]
        cost[own["w"]] += kept.values(own["v"].to_numpy(np.int64), own["w"].to_numpy(np.int64), own["n"].to_numpy(np.int64))
        assert np.exp(-cost / quality.STEPS).sum() == pytest.approx(1, abs=2e-3)
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    r = quality.quality_filter(docs.unionByName(frame(spark, ["%%%$$$###"], [9])), labels).collect()
    assert {x.doc_id: x.kept for x in r}[9] is False and {x.doc_id: x.kept for x in r}[0] is True
    assert quality.quality_filter(docs, labels.limit(0)).filter("kept").count() == 4


def test_mixing_meets_its_targets(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(["plain", "words", "here"], k=30)) if i % 4 else "%%% $$$ " * 20 for i in range(200)]
    docs = frame(spark, texts)
    lab = spark.createDataFrame([(i, "good" if i % 4 else "bad") for i in range(100)], "doc_id bigint, domain string")
    mix = mixing.fit_mixture(docs, lab, {"good": 0.9, "bad": 0.1})
    r = mixing.document_rates(docs, mix).collect()
    good = mix.domains.index("good")
    mass = [sum(x.rate * x.n_tokens * x.posterior[k] for x in r) for k in range(2)]
    assert mass[good] / sum(mass) == pytest.approx(0.9, abs=0.01) and all(x.rate >= 0 for x in r)
    assert set(mix.residuals) == {"good", "bad"} and max(map(abs, mix.residuals.values())) < 1e-3 and mix.unmet == []
    assert mixing.fit_mixture(docs, lab, {"good": 0.5, "bad": 0.2, "never": 0.3}).unmet == ["never"]
    out = mixing.apply_rates(docs.withColumnRenamed("source", "_mix_f"), mixing.fit_mixture(docs, lab, {"good": 0.9, "bad": 0.1}, least=1.0))
    assert out.select("doc_id").distinct().count() == 200 and "_mix_f" in out.columns
    odd = mixing.document_rates(frame(spark, ODD), mix)
    assert odd.count() == len(ODD) and odd.filter("rate is null or isnan(rate)").count() == 0
    untaught = mixing.fit_mixture(docs, lab.limit(0), {"good": 1.0})
    assert mixing.document_rates(docs, untaught).filter("rate <> 1").count() == 0 and untaught.unmet == ["good"]
    assert mixing.fit_mixture(docs.limit(0), lab, {"good": 1.0}).unmet == ["good"]


def test_toxicity_learns_from_confirmed_rows(spark):
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(200)]
    texts, toxic = [], []
    for i in range(600):
        w = rng.choices(vocab, k=30)
        toxic.append(int(i % 8 == 0))
        texts.append(" ".join([*w, rng.choice(["jerk", "Fool", "creep"])] if toxic[-1] else w))
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, t if i % 7 else None) for i, t in enumerate(toxic)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train_toxicity(docs, labels)
    r = {x.doc_id: x for x in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in r if r[i].held_out]
    assert held and all(r[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in r)
    assert sum(r[i].predicted == toxic[i] for i in held) / len(held) > 0.97
    left = toxicity.drop_toxic(docs.unionByName(frame(spark, [None, ""], [900, 901])), model)
    assert left.count() == 602 - sum(x.predicted for x in r.values()) and left.columns == docs.columns
    blank = toxicity.train_toxicity(docs, labels.limit(0))
    assert toxicity.score_toxicity(frame(spark, ODD), blank).filter("predicted = 1").count() == 0


def test_toxicity_knows_inflected_and_misspelt_words(spark):
    rng = random.Random(19)
    vocab = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    stems, ends = ["wortless", "loweik", "pathet"], ["", "a", "er", "ing", "ous", "ly", "ness", "um"]
    texts, toxic = [], []
    for i in range(900):
        toxic.append(int(i % 6 == 0))
        w = rng.choices(vocab, k=25)
        texts.append(" ".join(w + [rng.choice(stems) + rng.choice(ends[:5])] * toxic[-1]))
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train_toxicity(frame(spark, texts), labels)
    clean = [" ".join(rng.choices(vocab, k=25)) for _ in range(200)]
    new = [" ".join([*rng.choices(vocab, k=25), s + rng.choice(ends[5:])]) for s in stems * 20] + [" ".join([*rng.choices(vocab, k=25), s]) for s in ("wortles", "lowweik", "patheet")]
    long = ["word " * 40_000 + x for x in ("", " loweikness")]
    score = model.scores(clean + new + long, model.features())
    assert np.mean(np.array(score[200:260]) > np.quantile(score[:200], 0.9)) > 0.95 and min(score[260:263]) > np.quantile(score[:200], 0.8)
    assert score[-1] > score[-2] and score == model.scores(clean + new + long, model.features())
    # every column stays as it is, whole numbers beside nulls too
    docs = spark.createDataFrame([(2**60 + 1, None, 2**60 + 3, {"a": 1}), (None, "x", None, None)], "doc_id bigint, text string, score bigint, extra map<string,int>")
    assert sorted(map(str, toxicity.drop_toxic(docs, model).collect())) == sorted(map(str, docs.collect()))


def test_features_of_a_word_do_not_depend_on_its_company():
    words = ["loweia", "a", "idiot", "éé", "x" * 100]
    places, owner = toxicity.word_features(words)
    for k, w in enumerate(words):
        assert sorted(places[owner == k]) == sorted(toxicity.word_features([w])[0])
    got = list(toxicity.Features(memory=1).of([None, "", "A a", "idiot", "x" * 2000, "idiot"]))
    assert [len(g) > 0 for g in got] == [False, False, True, True, True, True] and np.array_equal(got[3], got[5])


def test_empty_tables(spark):
    docs = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert tokens.count_tokens(docs).count() == packing.pack_power_of_two(docs).count() == licences.licence_scan(docs).count() == 0
    assert dedup.exact_dedup(docs).count() == near.jaccard_components(docs).count() == quality.quality_filter(docs, labels).count() == 0
    assert pages.extract_main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_null_ids_and_repeated_rows(spark):
    big = 2**60 + 1
    docs = frame(spark, ["same text", "same text", "other one", "other one", None], [big, None, None, None, big + 2])
    docs = docs.union(docs.filter(docs.doc_id == big))
    labels = spark.createDataFrame([(big, 1, 1), (None, None, None)], "doc_id bigint, quality int, toxic int")
    ids = Counter([big, big, big + 2, None, None, None])
    for out in (tokens.count_tokens(docs), licences.licence_scan(docs), near.jaccard_components(docs), quality.quality_filter(docs, labels), toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)), dedup.exact_dedup(docs)):
        assert Counter(r.doc_id for r in out.collect()) == ids
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in dedup.exact_dedup(docs).collect()}
    assert got == {(big, big, 3, True), (None, big, 3, False), (None, None, 2, True), (big + 2, big + 2, 1, True)}
    assert {(r.doc_id, r.component_id) for r in near.jaccard_components(docs).collect()} == {(big, big), (None, big), (None, None), (big + 2, big + 2)}
    assert packing.pack_power_of_two(docs).filter("doc_id is null").count() >= 3
    left = dedup.drop_copies(docs)
    assert Counter(r.doc_id for r in left.collect()) == Counter([big, None, big + 2])
    assert near.keep_one_of_each(docs).columns == docs.columns


def test_pipeline_on_small_rows(spark, tmp_path):
    import corpus_pipeline

    texts = [f"document number {i} " + " ".join(random.Random(i).choices([f"v{k}" for k in range(500)], k=80)) for i in range(30)]
    texts += [texts[3], texts[4] + " extra", None, "", "x"]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1 if i % 5 else 0, 0) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, want = spark.read.parquet(str(tmp_path / "documents.parquet")), set(range(35)) - {30, 31, 33}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == want
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()} == want


def test_word_model_sees_the_order_of_words(spark):
    text = "the old cat sat on the warm mat and the young dog ran to the far door"
    docs = frame(spark, [text, text + " again", text + " today", text, " ".join(sorted(text.split())), "the " * 16])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id bigint, quality int, toxic int")
    p = {r.doc_id: r.perplexity for r in quality.quality_filter(docs, labels).collect()}
    assert p[4] > 1.5 * p[3] and p[5] > 1.5 * p[3]


def test_bigram_model_grows_and_hot_bigrams_and_parts_change_nothing(spark, library, monkeypatch):
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choices("abcde", k=4)) for _ in range(50)) for _ in range(40)]
    docs = frame(spark, texts)
    (small, _), (large, kept) = _bigram_model(docs, 10), _bigram_model(docs, 40)
    assert large.count() > 2 * small.count()

    def scores(hot):
        return {r.doc_id: (r.perplexity, r.perplexity_by_others) for r in quality.perplexity(docs, large, kept, PATH, hot).collect()}

    a = scores(1 << 17)
    assert a == scores(0) == scores(100) and len(a) == 40
    monkeypatch.setattr(quality, "_PART", 200)
    assert a == scores(0)
    # brute force: the interpolated model without logarithms of parts
    size = library.get_vocab_size()
    ids = [[size, *library.encode(t, add_special_tokens=False).ids, size] for t in texts]
    c2 = Counter(p for i in ids for p in zip(i, i[1:]))
    assert {(r.v, r.w): r.n for r in large.collect()} == c2
    c1, total, ctx = Counter(w for _, w in c2), Counter(), defaultdict(list)
    for (v, _), n in c2.items():
        total[v] += n
        ctx[v].append(n)

    def less(counts):
        k = Counter(counts)
        if not (k[1] and k[2] and k[3]):
            return lambda n: [0, 0.5, 0.75, 0.9][min(n, 3)]
        y = k[1] / (k[1] + 2 * k[2])
        d = [0, *(min(max(i - (i + 1) * y * k[i + 1] / k[i], 0.01), i) for i in (1, 2, 3))]
        return lambda n: d[min(n, 3)]

    d2, d1 = less(c2.values()), less(c1.values())
    back1 = sum(min(d1(n), n) for n in c1.values()) / len(c2)
    for i in (0, 7):
        for at in (0, 1):
            own, cost = Counter(zip(ids[i], ids[i][1:])), 0.0
            for (v, x), m in own.items():
                p1 = (c1[x] - min(d1(c1[x]), c1[x])) / len(c2) + back1 / (size + 1)
                n = c2[v, x] if not at or c2[v, x] > m else 0
                cost -= m * np.log(max(n - d2(n), 0) / total[v] + sum(map(d2, ctx[v])) / total[v] * p1)
            assert a[i][at] == pytest.approx(np.exp(cost / (len(texts[i]) + 1)), rel=1e-3)


def test_quality_of_odd_rows(spark):
    docs = frame(spark, [*ODD, "a b c"], [*range(len(ODD)), 4])
    labels = spark.createDataFrame([(i, 1, 0) for i in (4, 5, 6, 7, 9)], "doc_id bigint, quality int, toxic int")
    got = quality.quality_filter(docs, labels).collect()
    assert sorted(r.doc_id for r in got) == sorted([*range(len(ODD)), 4]) and all(r.perplexity >= 1 and r.threshold for r in got)
    assert {r.doc_id: r.n_bytes for r in got}[9] == len(LONG)


def _texts(spark, htmls, hosts=None):
    rows = [(i, f"http://{hosts[i] if hosts else 'h.com'}/{i}", h) for i, h in enumerate(htmls)]
    return {r.page_id: r.text for r in pages.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def test_recurring_prose_within_an_article_is_template(spark):
    page = "<body><article><h1>Title {n}</h1><p>Only page {n} says these many words of its own</p><ul><li>Sign up for our letter</li></ul></article></body>"
    # a twentieth of the host isn't asked for: the template is on 12 of 300 pages
    others = [f"<article><h1>Other {n}</h1><p>Another text, number {n}</p></article>" for n in range(288)]
    got = _texts(spark, [page.format(n=n) for n in range(12)] + others)
    assert got[3] == "Title 3\nOnly page 3 says these many words of its own" and got[20] == "Other 8\nAnother text, number 8"


def test_copied_articles_and_pages_stay(spark):
    copied = "<article><h1>Copied</h1><p>A paragraph that was copied</p><p>and one more of them</p></article>"
    bare = "<body><div><p>A page without an article</p><p>copied whole</p></div></body>"
    one = "<main><h1>Title {n}</h1><p>The same words under each title</p></main>"
    got = _texts(spark, [copied] * 12 + [bare] * 12 + [one.format(n=n) for n in range(12)], ["a"] * 12 + ["b"] * 12 + ["c"] * 12)
    assert got[0] == "Copied\nA paragraph that was copied\nand one more of them" and got[12] == "A page without an article\ncopied whole"
    assert got[24] == "Title 0\nThe same words under each title"


def test_names_of_wrappers_never_delete_an_article():
    text = lambda html: [t for t, _, _ in pages.blocks(html)]
    for wrapper in ('class="layout has-sidebar"', 'class="content no-comments"', 'class="layout sidebar"', 'id="share"', 'role="search"'):
        assert text(f"<body><div {wrapper}><article><h1>T</h1><p>words</p></article></div></body>") == ["T", "words"]
    assert text('<article><div class="entry-header header"><h1>T</h1></div><p>words</p></article>') == ["T", "words"]
    assert text("<form><main><p>words</p></main></form>") == ["words"]
    assert text('<article class="post no-comments sidebar"><p>words</p></article>') == ["words"]
    # what a name does delete
    assert text('<article><p>words</p></article><div class="comments"><article><h1>Re</h1><p>no</p></article></div>') == ["words"]
    assert text('<article><p>words</p><div class="x ad">no</div><p style="display: none">no</p></article><aside><article>no</article></aside>') == ["words"]
    assert text('<article><p>words</p></article><article class="comment"><p>no</p></article>') == ["words"]


def test_sets_of_one_least_key_are_dealt_to_bounded_blocks(spark):
    nodes = spark.range(6000).selectExpr("id as sid", "if(id % 3 = 0, id, 7) as least", "60L as n")
    got = Counter(r.block for r in near._blocks(nodes, 300, 12_000_000).collect())
    assert sum(got.values()) == 6000 and max(got.values()) < 600
    # bytes count, too
    got = Counter(r.block for r in near._blocks(nodes, 6000, 144_000).collect())
    assert max(got.values()) < 600


def test_a_passage_that_unlinked_texts_share(spark):
    rng = random.Random(12)
    passage = [f"p{k}" for k in range(50)]
    texts = [" ".join(passage + rng.choices([f"q{k}" for k in range(400)], k=14)) for _ in range(60)]
    texts += [texts[5] + " more", texts[40] + " words"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.jaccard_components(frame(spark, texts)).collect()}
    assert got == brute_components(range(len(texts)), texts)


def test_any_nesting_and_any_quotes():
    text = lambda html: [t for t, _, _ in pages.blocks(html)]
    deep = "<div>" * 5000
    assert text(f"<body>{deep}words{'</div>' * 5000}<p>more</p>") == ["words", "more"]
    assert len(pages.read_page("<div>a" * 3000).subtrees) == 3000
    assert text("<p title=it's>one two</p><p>three don't four</p>") == ["one two", "three don't four"]
    assert text('<p data-x=5">words</p>') == ["words"] and text('<p title="a>b" class=x>words') == ["words"]
    assert text("<p title='open>words</p><p>more</p>")[-1] == "more"
    long = "<p>" + "word " * 100_000 + "</p>"
    assert len(text(long * 2)) == 2


def test_a_teaser_does_not_shut_out_the_page():
    text = lambda html: [t for t, _, _ in pages.blocks(html)]
    assert text("<article><h2>Teaser</h2></article><div><p>A long text that is the body of this page</p></div>")[-1] == "A long text that is the body of this page"
    assert text("<main><p>x</p></main><div><p>A long text that is no body</p></div>") == ["x"]
    two = text("<article><p>first article here</p></article><article><p>second one here</p></article><div>menu</div>")
    assert two == ["first article here", "second one here"]


def test_template_counts_brute_force(spark):
    rng = random.Random(21)
    parts = [f"<div><p>part {k}</p></div>" for k in range(6)]
    htmls = [f"<body>{''.join(rng.sample(parts, 3))}<div><p>the own text of page {n % 40}</p></div></body>" for n in range(90)]
    hosts = [rng.choice(["a.com", "b.com", "c.com"]) for _ in htmls]
    got = _texts(spark, htmls, hosts)
    found = defaultdict(set)
    for h, html in zip(hosts, htmls, strict=True):
        own = re.findall("<p>(.*?)</p>", html)
        for t in own:
            found[h, t].add(max((x for x in own if x != t), key=len))
    for n, (h, html) in enumerate(zip(hosts, htmls, strict=True)):
        assert got[n] == "\n".join(t for t in re.findall("<p>(.*?)</p>", html) if len(found[h, t]) < 10)


def test_top_k_with_large_components_ties_and_repeated_rows(spark):
    vecs = [(0, [1e6, -2.5]), (1, [1e30, 1.0]), (2, [3e6, 1.0]), (3, [3e6, 1.0]), (3, [3e6, 1.0]), (4, [-1e30, 5.0]), (5, [1.0, 1.0]), (6, [1e6, 0.0])]
    df = spark.createDataFrame(vecs, "vec_id bigint, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in topk.top_k_inner(df.filter("vec_id = 0"), df, 6, row_block=3).orderBy("rank").collect()]
    q = {i: [int(np.floor(256 * x)) for x in v] for i, v in vecs}
    want = sorted(((-max(min(sum(x * y for x, y in zip(q[0], q[i], strict=True)), 2**63 - 1), -(2**63)), i) for i, _ in vecs if i), key=lambda x: x)[:6]
    assert got == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_exact_dedup_with_text_ids_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(dedup, "A_SHARD", 5)
    rng = random.Random(20)
    rows = [(f"id{rng.randrange(10**6)}" if k % 9 else None, f"text {rng.randrange(20)}") for k in range(120)]
    got = Counter((r.doc_id, r.keep_id, r.group_size) for r in dedup.exact_dedup(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert got == Counter((i, min((x for x in groups[t] if x is not None), default=None), len(groups[t])) for i, t in rows)


def test_licence_expressions_brute_force(spark):
    rng = random.Random(22)
    names = {"mit": "mit", "gpl-2.0": "gpl", "apache-2.0": "apache", "zlib": "zlib", "x-1": "x-1"}
    free = {"mit", "apache"}

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            n = rng.choice(sorted(names))
            return n, {names[n]}, names[n] in free
        (a, x, p), (b, y, q) = make(depth - 1), make(depth - 1)
        op = rng.choice(["and", "or"])
        return f"({a} {op} {b})", x | y, (p and q) if op == "and" else (p or q)

    for _ in range(200):
        e, labels, ok = make(4)
        assert licences.evaluate(licences.postfix(e)) == (labels, ok)
        for tail in (" and some more prose", " or", " and (mit", ") x", ". See the file", ""):
            assert licences.leading(e.upper() + tail).replace(" ", "") == e.replace(" ", "")
    tag = "SPDX-License-Identifier: "
    got = licences.licence_scan(frame(spark, [f"x {tag}MIT and some more prose", f"{tag}MIT OR\nnext", f"{tag}of this file", "word " * 50_000 + f"{tag}Zlib", f"{tag}MIT\n" * 2])).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["mit,permissive", "mit,permissive", "", "zlib", "mit,permissive"]
    assert [round(r.score, 6) for r in got] == [0.9, 0.9, 0.0, 0.9, 0.99]
