"""Quality rules, BPE, license scans, language ID, token counts: against brute force."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF_SMALL
from waterbook.llm import bpe, language_id, license_scan, quality, queries, token_counts
from waterbook.llm.common import exact_quantile, public_vocabulary, table

WORD = "[^\x20\x09-\x0D]+"
ODD = [
    (1, ""), (2, None), (3, " \t\n"), (4, "one"), (4, "one"), (None, "a b a b a b"), (5, "x y z " * 400),
    (6, "### a\n\na ###\n### a\n" * 3), (7, "é" * 3000), (8, "w" * 100_000), (9, " ".join(f"w{i % 40}" for i in range(3000))),
]


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and a column named as an output."""
    return spark.createDataFrame([(i, t, "en", "s", 7) for i, t in ODD], "doc_id long, text string, lang string, source string, kept int")


def small(spark):
    return table(spark, SF_SMALL, "documents")


def counted(text):
    w = re.findall(WORD, text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark):
    model = quality.QualityModel((0,) * 64, 0.0)
    docs = small(spark).select("doc_id", "text").union(odd_docs(spark).select("doc_id", "text"))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(tuple(r) for r in quality.apply(docs.coalesce(2), model).select(F.coalesce("doc_id", F.lit(-1)), *quality.COUNTS, "base_failed", "kept").collect())
    want = []
    for i, t in texts:
        c = counted(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want.append((-1 if i is None else i, *c, failed, not failed))
    assert got == sorted(want)


def test_quality_filter_keeps_columns_and_clean_documents(spark):
    docs, labels = small(spark), table(spark, SF_SMALL, "labels")
    model = quality.fit(docs, quality.trusted_ids(labels))
    kept = quality.filter_documents(docs, model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    judged = {r.doc_id: r for r in quality.apply(docs, model).collect()}
    assert ids == {i for i, r in judged.items() if r.kept}
    for r in labels.filter("quality = 1").collect():
        assert judged[r.doc_id].kept or judged[r.doc_id].base_failed
    bad = [r.doc_id for r in labels.filter("quality = 0").collect()]
    assert not ids & set(bad)


def test_quality_score_is_the_mean_log_ratio(spark):
    xxhash = pytest.importorskip("xxhash")
    weights = tuple(random.Random(1).randint(-(10**6), 10**6) for _ in range(64))
    text = "alpha beta gamma délta ##"

    def h(data, seed=42):
        v = xxhash.xxh64_intdigest(data, seed & (2**64 - 1))
        return v - 2**64 if v >= 2**63 else v

    tokens = [h(w.encode()) for w in text.split()]  # each one run of letters or of signs
    total = sum(weights[a % 64] for a in tokens)
    for a, b in zip(tokens, tokens[1:]):
        first = h((a % 2**64).to_bytes(8, "little"))
        total += weights[h((b % 2**64).to_bytes(8, "little"), first) % 64]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = quality.apply(df, quality.QualityModel(weights, 0.0)).first().score
    assert got == pytest.approx(total / (2 * len(tokens) - 1) / 1e6, abs=1e-12)


def test_quality_reads_whole_words(spark):
    docs, labels = small(spark).select("doc_id", "text"), table(spark, SF_SMALL, "labels")
    model = quality.fit(docs, quality.trusted_ids(labels))
    best = max(quality.apply(docs, model).filter("kept").collect(), key=lambda r: r.score).doc_id
    text = docs.filter(F.col("doc_id") == best).first().text
    junk = re.sub(WORD, lambda m: "qx" + m[0][-3:], text)  # other words of the same endings
    got = {r.doc_id: r for r in quality.apply(spark.createDataFrame([(1, text), (2, junk)], "doc_id long, text string"), model).collect()}
    assert got[1].kept and got[2].score < got[1].score


@pytest.mark.parametrize("name", ["op2_mix_sources", "op6_fingerprints", "op10_quality_rules"])
def test_filters_on_results_do_not_blow_up_the_plan(spark, name):
    """No column's expression is put back for each mention of it."""
    df = queries.QUERIES[name](spark, SF_SMALL)
    size = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString())
    plain = size(df)
    for column in df.columns:
        assert size(df.filter(F.col(column).isNotNull() & (F.col(column).cast("string") != "-"))) <= 1.5 * plain, column


def test_quality_learns_from_every_trusted_document(spark):
    """More trusted documents than any bound: each counts, and so does its score."""
    n = 20_500
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("alpha beta w"), F.col("id").cast("string")).alias("text"))
    docs = docs.union(spark.createDataFrame([(n + i, "gamma delta") for i in range(300)] + [(None, "gamma")], "doc_id long, text string"))
    labels = docs.filter(f"doc_id < {n}").select("doc_id")
    model = quality.fit(docs, labels.union(labels), buckets=1 << 16, quantile=0.5, margin=0.0)
    joined = quality.fit(docs, labels, buckets=1 << 16, quantile=0.5, margin=0.0, max_broadcast=100)
    assert joined == model
    h = quality.token_hashes(F.col("text"))
    grams = docs.select("doc_id", F.explode(quality.grams(h, 1 << 16)).alias("g"))
    raw, target = (Counter({r.g: r["count"] for r in d.groupBy("g").count().collect()}) for d in (grams, grams.join(labels, "doc_id", "left_semi")))
    n_raw, n_target = sum(raw.values()) + (1 << 16), sum(target.values()) + (1 << 16)
    assert n_target == 5 * n + (1 << 16)
    for g in [*list(raw)[:200], 0, 65535]:
        assert model.weights[g] == round(1e6 * (math.log((target[g] + 1) / n_target) - math.log((raw[g] + 1) / n_raw)))
    scores = quality.apply(docs.join(labels, "doc_id", "left_semi"), model)
    assert model.threshold == pytest.approx(scores.agg(F.percentile("score", 0.5)).first()[0], abs=1e-6)


def test_exact_quantile_is_the_percentile(spark):
    for values in ([3.0], [2.0, 1.0], [5.0, None, 1.0, 1.0, 9.0, -2.0, 4.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        for q in (0.0, 0.002, 0.5, 0.73, 0.999, 1.0):
            assert exact_quantile(df, "x", q) == pytest.approx(df.agg(F.percentile("x", q)).first()[0])
    assert exact_quantile(df.limit(0), "x", 0.5) is None


def test_quality_of_nothing(spark):
    empty, labels = odd_docs(spark).limit(0), table(spark, SF_SMALL, "labels").limit(0)
    model = quality.fit(empty, quality.trusted_ids(labels))
    assert model.threshold == 0.0 and quality.apply(empty, model).count() == 0
    assert quality.filter_documents(odd_docs(spark), model).columns == odd_docs(spark).columns


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    path = public_vocabulary(name)
    lib, own = Tokenizer.from_file(path), bpe.Encoder(json.loads(bpe.read_spec(path)))
    rnd = random.Random(1)
    pool = [chr(c) for c in [*range(0, 0x250), *range(0x300, 0x380), 0x1680, 0x2028, 0x3000, 0x4E00, 0x1F600, 0x3A3]]
    for _ in range(1500):
        s = "".join(rnd.choice(pool) if rnd.random() < 0.4 else rnd.choice("ab AB'stre<|endoftext|>") for _ in range(rnd.randint(0, 30)))
        s += rnd.choice(["", "<|endoftext|>" + s[:5]])
        ids = lib.encode(s, add_special_tokens=False).ids
        assert list(memoryview(own.encode(s)).cast("i")) == ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_short_merges_equal_the_queue(name, monkeypatch):
    own, rnd = bpe.Encoder(json.loads(bpe.read_spec(public_vocabulary(name)))), random.Random(8)
    words = ["".join(rnd.choice("aaeeinorst.!é漢🎉") for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["a" * 40, "the", ""]
    short = [own.merge(w) for w in words]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [own.merge(w) for w in words] == short


def test_bpe_query_digests(spark):
    lib = Tokenizer.from_file(public_vocabulary("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in small(spark).collect()}
    rows = queries.op4_bpe(spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip_is_encode_then_decode(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 1000)  # the table of known words starts anew again and again
    path = public_vocabulary("word_bpe_49k.json")
    docs = small(spark)
    two = bpe.decode(bpe.encode(docs, path), path)
    assert sorted(map(repr, bpe.round_trip(docs, path, piece=500).collect())) == sorted(map(repr, two.collect()))


def test_bpe_of_odd_rows(spark):
    path = public_vocabulary("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = bpe.decode(bpe.encode(odd_docs(spark), path, piece=500), path).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, len(r.ids)) for r in got) == sorted(
        (i is None, i or 0, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD
    )
    assert bpe.encode(odd_docs(spark).limit(0), path).count() == 0


def test_license_lines_and_edited_notices(spark):
    mit = license_scan.NOTICES["MIT"]
    words = mit.split()
    edited = " ".join(w for i, w in enumerate(words) if i % 19)  # every 19th word lost
    texts = {
        1: "é intro.\n" + mit + " tail", 2: edited, 3: "permission is hereby granted to all of you", 4: None, 5: "",
        6: "Licensed under CC BY-NC 4.0. and again Licensed under CC BY-NC 4.0.", 7: " ".join(words[:60]),
    }
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, coverage int")
    got = license_scan.scan(docs).collect()
    by = Counter((r.doc_id, r.template) for r in got)
    assert by == {(1, "MIT"): 1, (2, "MIT"): 1, (6, "CC-BY-NC-4.0 (line)"): 2}
    first = next(r for r in got if r.doc_id == 1)
    assert first.coverage == 1.0 and texts[1][first.start : first.end] + "." == mit
    second = next(r for r in got if r.doc_id == 2)
    assert second.matched == len(re.findall(r"[0-9A-Za-z]+", edited))
    assert license_scan.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(docs, {"short": "two words"})


def test_of_overlapping_licenses_the_best(spark):
    n = license_scan.NOTICES
    lines = [n["CC-BY-SA-4.0 (line)"], n["CC-BY-4.0 (line)"]]
    inside = n["ISC"].replace("any purpose", n["MIT (line)"] + " any purpose")
    texts = {1: lines[0], 2: lines[1], 3: " ".join(lines * 3), 4: n["Apache-2.0"], 5: inside}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = license_scan.scan(docs, least_coverage=0.8).collect()
    got = Counter((r.doc_id, r.template) for r in rows)
    assert got == {(1, "CC-BY-SA-4.0 (line)"): 1, (2, "CC-BY-4.0 (line)"): 1, (3, "CC-BY-SA-4.0 (line)"): 3,
                   (3, "CC-BY-4.0 (line)"): 3, (4, "Apache-2.0"): 1, (5, "ISC"): 1, (5, "MIT (line)"): 1}
    assert {r.template: r.inserted for r in rows if r.doc_id == 5} == {"ISC": 5, "MIT (line)": 0}
    every = Counter((r.doc_id, r.template) for r in license_scan.scan(docs, alternatives=True).collect())
    assert every[1, "CC-BY-4.0 (line)"] == every[2, "CC-BY-SA-4.0 (line)"] == 1


def test_license_query_finds_every_line(spark):
    texts = {r.doc_id: r.text for r in small(spark).collect()}
    want = Counter((i, n) for i, t in texts.items() for n, line in license_scan.NOTICES.items() for _ in range(t.count(line)))
    got = Counter((r.doc_id, r.template) for r in queries.op5_license_scan(spark, SF_SMALL).collect())
    assert got == want


def test_language_of_held_out_documents(spark):
    rows = queries.op7_language_id(spark, SF_SMALL).collect()
    lang = {r.doc_id: r.lang for r in small(spark).collect()}
    held = [r for r in rows if r.held_out]
    assert held and len(rows) == len(lang)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    model = language_id.fit(small(spark))
    rows = [(1, None), (2, ""), (3, "123 ### 456"), (4, "x"), (4, "x"), (None, "the and of the"), (5, "\x01 the thing " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.prediction for r in language_id.identify(df, model).collect()}
    for i in (1, 2, 3):
        assert (got[i].lang, got[i].score, got[i].accepted) == ("und", 0.0, False)
    assert got[None].lang == "en" and got[5].lang == "en"
    nothing = language_id.fit(small(spark).limit(0))
    assert {r.prediction.lang for r in language_id.identify(df, nothing).collect()} == {"und"}


def test_foreign_texts_are_rejected_and_unseen_ones_kept(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    unseen = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.filter(~unseen), **language_id.CALIBRATION)
    clean = language_id.identify(docs.filter(unseen), model).select("prediction.*").filter("n > 0").collect()
    assert sum(r.accepted for r in clean) >= 0.99 * len(clean)
    rnd = random.Random(8)
    drawn = lambda letters, n: " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 9))) for _ in range(n))
    polish = "witaj w domu mojego przyjaciela gdzie wszyscy rozmawiają o pogodzie i jedzą pierogi z kapustą "
    russian = "пример текста на другом языке который модель никогда не видела раньше и должна отвергнуть "
    texts = [drawn("abcdefghijklmnopqrstuvwxyz", n) for n in (15, 40, 200, 2000)] + [polish * n for n in (1, 9)] + [russian * n for n in (1, 9)]
    foreign = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert not any(r.prediction.accepted for r in language_id.identify(foreign, model).collect())


def test_kept_apart_texts_of_few_or_no_texts(spark):
    rows = [(f"wort {i} der sprache und noch mehr davon", "de") for i in range(80)] + [("une seule phrase", "fr"), (None, "de"), ("x", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = language_id.fit(df, apart=4)
    got = language_id.identify(df.filter("text is not null and lang is not null"), model).select("lang", "prediction.*").toDF("stated", "lang", "score", "entropy", "n", "accepted").collect()
    assert all(r.accepted and r.lang == r.stated for r in got)
    assert language_id.fit(df.limit(0), apart=4).languages == []
    every = language_id.fit(df, apart=1, least_texts=10)  # all of one language kept apart
    assert every.languages == ["fr"]


def test_stored_language_model_has_every_ngram(spark):
    import numpy as np

    docs = small(spark)
    model = language_id.fit(docs)
    whole = language_id.kneser_ney(language_id.count_ngrams(docs, "text", "lang").toPandas())
    texts, letters = [r.text for r in docs.orderBy("doc_id").limit(40).collect()] + ["an unseen жук qqqq"], language_id.letter_table()
    got, want = model.entropies(texts, letters), whole.entropies(texts, letters)
    assert model.languages == whole.languages
    np.testing.assert_allclose(got[1], want[1], rtol=1e-5)
    model.held, model.room = {}, 0  # nothing kept: parts are read again
    np.testing.assert_allclose(model.entropies(texts, letters)[1], got[1])


def test_left_out_text_is_scored_as_if_not_counted(spark):
    import numpy as np

    docs = small(spark).filter("text is not null and lang is not null").select("text", "lang").orderBy("doc_id").limit(60)
    first = docs.limit(1).first()
    docs = docs.union(spark.createDataFrame([(first.text, first.lang), ("x", "xx"), (first.text, "xx")], docs.schema))
    model, letters = language_id.fit(docs, leave_out=True), language_id.letter_table()
    at = {x: i for i, x in enumerate(model.languages)}
    rows = Counter(map(tuple, docs.collect()))
    some = [(first.text, first.lang), ("x", "xx"), *list(rows)[5:9]]
    own, copies = np.array([at[x] for _, x in some]), np.array([rows[x] for x in some])
    assert copies[0] >= 2
    texts = [t for t, _ in some]
    n, h, _, left = model.left_out(texts, letters, own, copies)
    np.testing.assert_allclose(h, model.entropies(texts, letters)[1])
    for i, (t, x) in enumerate(some):
        rest = language_id.store_model(language_id.count_ngrams(docs.filter(~((F.col("text") == t) & (F.col("lang") == x))), "text", "lang"))
        assert rest.languages == model.languages
        rest.discount, rest.alphabet = model.discount, model.alphabet
        np.testing.assert_allclose(left[i], rest.entropies([t], letters)[1][0, own[i]], rtol=1e-5)
        assert left[i] >= h[i, own[i]]
    alone = model.left_out(["x", "", "the"], letters, np.array([-1, 0, -1]), np.array([0, 1, 0]))
    assert np.isnan(alone[3]).all()


def test_every_text_is_counted_and_calibrates(spark, monkeypatch):
    """No text is kept out, and one odd text decides the usual entropy too."""
    rnd = random.Random(9)
    line = lambda n: " ".join("".join(rnd.choice(["ta", "no", "ri", "lu"]) for _ in range(3)) for _ in range(n))
    df = spark.createDataFrame([(i, line(30), "aa") for i in range(200)], "doc_id long, text string, lang string")
    model, rows = language_id.learn_and_identify(df, **language_id.CALIBRATION)
    whole = language_id.kneser_ney(language_id.count_ngrams(df, "text", "lang").toPandas())
    texts, letters = [r.text for r in df.limit(20).collect()], language_id.letter_table()
    assert model.entropies(texts, letters)[1] == pytest.approx(whole.entropies(texts, letters)[1], rel=1e-5)
    monkeypatch.setattr(language_id, "COPIED", -1)  # joined, not broadcast
    fitted = language_id.fit(df, **language_id.CALIBRATION)
    assert (fitted.usual, fitted.allowed, fitted.limit) == (pytest.approx(model.usual), pytest.approx(model.allowed), model.limit)
    every = model.left_out([r.text for r in df.collect()], letters, np_zeros(200), np_zeros(200) + 1)
    assert model.usual[0] == pytest.approx((every[3] * every[0]).sum() / every[0].sum(), abs=1e-6)
    want = {r.doc_id: r.prediction for r in language_id.identify(df, fitted).collect()}
    for r in rows.collect():
        assert (r.prediction.lang, r.prediction.accepted) == (want[r.row.doc_id].lang, want[r.row.doc_id].accepted)
        assert r.prediction.entropy == pytest.approx(want[r.row.doc_id].entropy)


def np_zeros(n):
    import numpy as np

    return np.zeros(n, dtype=np.int64)


def test_language_beside_a_large_one_is_learned(spark):
    rnd = random.Random(5)
    hot = "".join(chr(0x4E00 + rnd.randrange(6000)) for _ in range(450_000))
    rare = "the small language has a few lines of text and is told by them "
    df = spark.createDataFrame([(1, hot, "aa"), (2, hot, "aa"), (3, rare, "zz")], "doc_id long, text string, lang string")
    model = language_id.fit(df)
    assert model.languages == ["aa", "zz"]
    got = language_id.identify(df.filter("doc_id = 3"), model).first().prediction
    assert got.lang == "zz"


def test_rare_language_is_calibrated_by_its_own_texts(spark):
    rnd = random.Random(6)
    line = lambda syllables, n: " ".join("".join(rnd.choice(syllables) for _ in range(3)) for _ in range(n))
    copies = [line(["ta", "no", "ri"], 80)] * 300
    rare = [line(["zyk", "wug", "plo"], 80) for _ in range(3)]
    rows = [(t, "aa") for t in [*copies, *(line(["ta", "no", "ri"], 80) for _ in range(200))]] + [(t, "zz") for t in rare]
    df = spark.createDataFrame(rows, "text string, lang string")
    for size in (20, 0):  # 0: no language has a calibration
        got = language_id.identify(df, language_id.fit(df, calibration_rows=size)).select("lang", "prediction.*").toDF("stated", "lang", "score", "entropy", "n", "accepted").collect()
        assert all(r.accepted and r.lang == r.stated for r in got)


def test_language_model_is_a_distribution():
    import numpy as np
    import pandas as pd

    rnd = random.Random(2)
    text = [ord(c) for c in "".join(rnd.choice("ab c") for _ in range(400))]
    grams = Counter(tuple(text[i : i + 4]) for i in range(len(text) - 3))
    table_ = pd.DataFrame([("x", (g[0] << 42) | (g[1] << 21) | g[2], g[3], n) for g, n in grams.items()], columns=["lang", "ctx", "sym", "n"])
    model = language_id.kneser_ney(table_)
    symbols = sorted({c for g in grams for c in g})
    for ctx in [*list(grams)[:20], (99, 99, 99, 0)]:
        cols = [np.full(len(symbols), c, dtype=np.uint64) for c in ctx[:3]] + [np.array(symbols, dtype=np.uint64)]
        total = np.exp(model.log_probabilities(cols)).sum()
        assert 0.9 < total <= 1.0 + 1e-5


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_count_tree_follows_edits(name):
    path = public_vocabulary(name)
    coder, lib = bpe.Encoder(json.loads(bpe.read_spec(path))), Tokenizer.from_file(path)
    rnd = random.Random(3)

    def word():
        return "".join(rnd.choice("abcdeéü'sTre1!%") for _ in range(rnd.randint(1, 9)))

    for _ in range(40):
        t = "".join(word() + rnd.choice([" ", "  ", "\n", " \n\t "]) for _ in range(rnd.randint(0, 300)))
        tree = token_counts.CountTree(t, coder)
        for _ in range(10):
            p, d = rnd.randint(0, len(t) + 3), rnd.choice([0, 0, 1, 5, 60, 500])
            new = rnd.choice(["", "x", " ", "  y z ", "'s", "<|endoftext|>", "".join(word() + " " for _ in range(200))])
            done = tree.edit(p, d, new)
            p = min(p, len(t))
            t = t[:p] + new + t[min(p + d, len(t)) :]
            assert (tree.text(), tree.n_chars) == (t, len(t))
            assert tree.n_tokens == len(lib.encode(t, add_special_tokens=False).ids)
            assert done <= len(new) + 3000


def test_edit_counts_of_odd_rows(spark):
    path = public_vocabulary("word_bpe_49k.json")
    edits = spark.createDataFrame(
        [(1, 1, 0, 0, "new text"), (2, None, None, None, None), (4, 2, 99, 5, " end"), (77, 1, 0, 0, "x"), (None, 1, 0, 0, "x")],
        "doc_id long, seq long, position long, deleted long, inserted string",
    )
    got = token_counts.count_edits(odd_docs(spark), edits, path).collect()
    by = Counter((r.doc_id, r.seq) for r in got)
    assert by == Counter((i, None) for i, _ in ODD) + Counter({(1, 1): 1, (2, None): 1, (4, 2): 2})
    assert {r.n_chars for r in got if (r.doc_id, r.seq) == (4, 2)} == {len("one end")}


def _edited(text, edits):
    """The text after each edit, plainly."""
    out = []
    for e in edits:
        p = min(max(e.position or 0, 0), len(text))
        text = text[:p] + (e.inserted or "") + text[min(p + max(e.deleted or 0, 0), len(text)) :]
        out.append(text)
    return out


def test_stored_trees_take_edits_again_and_again(spark, tmp_path):
    path = public_vocabulary("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rnd = random.Random(8)
    texts = {i: t or "" for i, t in ODD if i is not None and i != 4}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    where = str(tmp_path / "trees")
    token_counts.build_trees(docs, path).write.parquet(where)
    trees = spark.read.parquet(where)
    for turn in range(3):
        # some documents are left alone in every turn
        made = [(i, n, rnd.randint(0, len(t) + 2), rnd.choice([0, 3, 250]), rnd.choice(["", "x", " y z ", "ab " * 150])) for i, t in texts.items() for n in range(rnd.choice([0, 1, 3]))]
        edits = spark.createDataFrame(made, "doc_id long, seq long, position long, deleted long, inserted string")
        where = str(tmp_path / f"edited-{turn}")
        token_counts.edit_trees(trees, edits, path).write.parquet(where)
        out = spark.read.parquet(where)
        trees = token_counts.kept_trees(out)
        got = {(r.doc_id, r.seq): r for r in out.collect()}
        want = {i: _edited(t, [e for e in edits.collect() if e.doc_id == i]) for i, t in texts.items()}
        assert len(got) == len(made) + len(texts)
        for i, after in want.items():
            for n, t in enumerate(after):
                r = got[(i, n)]
                assert (r.n_chars, r.n_tokens) == (len(t), len(lib.encode(t, add_special_tokens=False).ids)) and r.pieces is None
            texts[i] = after[-1] if after else texts[i]
            kept = got[(i, None)]
            assert "".join(kept.pieces) == texts[i] and sum(kept.tokens) == kept.n_tokens
            assert kept.encoded_chars == sum(got[(i, n)].encoded_chars for n in range(len(after)))  # nothing else is encoded


def test_stored_trees_of_odd_rows(spark):
    path = public_vocabulary("word_bpe_49k.json")
    edits = spark.createDataFrame([(4, 2, 99, 5, " end"), (77, 1, 0, 0, "x"), (None, 1, 0, 0, "x")], "doc_id long, seq long, position long, deleted long, inserted string")
    trees = token_counts.build_trees(odd_docs(spark), path)
    out = token_counts.edit_trees(trees, edits, path)
    assert Counter(r.doc_id for r in token_counts.kept_trees(out).collect()) == Counter(i for i, _ in ODD)
    assert [r.n_chars for r in out.filter("pieces IS NULL").collect()] == [len("one end")] * 2
    none = token_counts.edit_trees(trees.limit(0), edits, path)
    assert none.count() == 0 and token_counts.build_trees(odd_docs(spark).limit(0), path).count() == 0


def test_op8_counts_equal_the_library_after_every_edit(spark):
    path = public_vocabulary("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    docs = small(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    edits = {}
    for e in token_counts.sample_edits(docs).collect():
        edits.setdefault(e.doc_id, []).append(e)
    want = {}
    for i, t in texts.items():
        mine = sorted(edits[i], key=lambda e: e.seq)
        for seq, after in zip([None, *[e.seq for e in mine]], [t, *_edited(t, mine)]):
            want[(i, seq)] = (len(after), len(lib.encode(after, add_special_tokens=False).ids))
    got = {(r.doc_id, r.seq): (r.n_chars, r.n_tokens) for r in queries.op8_token_counts(spark, SF_SMALL).collect()}
    assert got == want
