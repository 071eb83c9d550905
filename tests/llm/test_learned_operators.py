"""Token alignment, toxicity, vector codes: against brute force."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tests.conftest import SF_SMALL
from waterbook.llm import alignment, queries, toxicity, vector_codes
from waterbook.llm.bpe import byte_alphabet
from waterbook.llm.common import public_vocabulary, table

A, B = public_vocabulary("byte_bpe_50k.json"), public_vocabulary("piece_bpe_32k.model")

# --- token alignment


def want_alignment(texts: dict) -> dict:
    """Per key: counts, best links, sums and digest, by the libraries and sets."""
    import sentencepiece
    from tokenizers import Tokenizer

    whole, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    whole.encode_special_tokens = True
    byte = {c: i for i, c in enumerate(byte_alphabet())}
    raw_a = {i: bytes(byte[c] for c in s) for s, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items() if i != 50256}

    def raw_b(i):
        p = pieces.id_to_piece(i)
        m = re.fullmatch("<0x([0-9A-F]{2})>", p)
        return bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode()

    groups, links = {}, {}
    for key, text in texts.items():
        groups[key] = []
        a, b = (whole.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)) if text else ([], [])
        data = (" " + (text or "")).encode()
        if b"".join(raw_a[i] for i in a) != data or b"".join(map(raw_b, b)) != data:
            a, b = [], []
        ends = [np.cumsum([0, *(len(raw(i)) for i in ids)]).tolist() for raw, ids in ((raw_a.get, a), (raw_b, b))]
        both = sorted(set(ends[0]) & set(ends[1]))
        for lo, hi in pairwise(both):
            groups[key].append(tuple([i for i, e in zip(ids, end[1:], strict=True) if lo < e <= hi] for ids, end in zip((a, b), ends, strict=True)))
        links[key] = Counter((x, y) for ga, gb in groups[key] for x in ga for y in gb)
    count = Counter(p for own in links.values() for p in own)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = {}
    for key, own in links.items():
        g = groups[key]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out[key] = (
            sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()),
            sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()),
            hashlib.sha256(text.encode()).hexdigest() if g else "",
        )
    return out


COUNTED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD_TEXTS = [
    None, "", " ", "  two  blanks ", "a▁b", "<|endoftext|> </s> <unk> <0x41>", "nul\0l", "naïve café ﬁ 漢字 🙂🙂 ​́", "x" * 3000,
    "=" * 999 + " " * 500 + "\n\n\t" * 100, "The cat sat.\r\nThe cat sat.", "The cat sat.\r\nThe cat sat.", "ab " * 400,
]


def test_alignment_of_odd_texts(spark):
    """Texts that a tokenizer changes have no tokens; clashing columns and a
    null and a repeated key are no special case."""
    rows = [(i if i else None, t, 5, "x") for i, t in enumerate(ODD_TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block long, pairs string").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COUNTED) for r in alignment.align(docs, A, B).collect()}
    assert got == want_alignment({i: t for i, t, *_ in rows})
    assert got[4] == (0, 0, 0, 0, 0, 0, "") and got[None] == got[1] and got[10] == got[11]


def test_alignment_query_and_small_blocks(spark):
    docs = table(spark, SF_SMALL, "documents")
    want = want_alignment({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id: tuple(r[c] for c in COUNTED) for r in queries.op11_token_alignment(spark, SF_SMALL).collect()} == want
    blocks = alignment.align_blocks(docs.repartition(3), A, B, block_chars=1)  # a block per document
    got = alignment.document_links(blocks, alignment.link_table(blocks)).filter("n_links >= 0").collect()
    assert {r.doc_id: tuple(r[c] for c in COUNTED) for r in got} == want


def test_blocks_are_read_a_few_at_a_time(spark):
    """However many blocks a task writes, a row group, which a reader decodes
    up to 4096 rows of at once, holds few of them."""
    texts = {i: f"the cat number {i} sat on {i % 5} mats" for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    blocks = alignment.align_blocks(docs, A, B, block_chars=1)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in blocks.inputFiles()]
    rows = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(rows) == len(texts) and max(rows) <= alignment.BLOCKS_AT_ONCE
    got = alignment.document_links(blocks, alignment.link_table(blocks)).collect()
    assert {r.doc_id: tuple(r[c] for c in COUNTED) for r in got} == want_alignment(texts)


def test_alignment_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, A, B).collect() == []
    assert alignment.groups(docs, A, B).collect() == []


def test_groups_have_bytes_and_ids(spark):
    docs = spark.createDataFrame([(1, "thanedble Erstlich 🙂 ok"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r.groups for r in alignment.groups(docs, A, B).collect()}
    aligner = alignment.Aligner(alignment.read_spec(A), alignment.read_model(B))
    data = " thanedble Erstlich 🙂 ok".encode()
    assert rows[2] == [] and rows[1][0].start == 0 and rows[1][-1].end == len(data)
    for g in rows[1]:
        assert data[g.start : g.end] == b"".join(aligner.a.bytes[i] for i in g.a) == b"".join(aligner.b.bytes[i] for i in g.b)


@pytest.mark.parametrize("keep", [0.05, 0.5, 0.95, 1.0])
def test_group_ends_by_sets(keep):
    rnd = random.Random(int(keep * 100))
    for _ in range(1500):
        n = rnd.randint(1, 60)
        a, b = (sorted({n, *(x for x in range(1, n) if rnd.random() < keep)}) for _ in range(2))
        if rnd.random() < 0.3:
            b = [x for x in a if rnd.random() < 0.9 or x == n]
        both = set(a) & set(b)
        assert alignment.group_ends(a, b) == tuple([i + 1 for i, x in enumerate(e) if x in both] for e in (a, b))


@pytest.mark.parametrize("longest", [3, 255, 256, 1000])
def test_group_cuts_of_token_lengths(longest):
    rnd = random.Random(longest)
    for _ in range(300):
        n = rnd.randint(1, 60)
        sums = np.cumsum([rnd.choice([1, 2, longest]) for _ in range(n)])
        a, b = (np.array([x for x in sums[:-1] if rnd.random() < 0.8] + [sums[-1]]) for _ in range(2))
        both = np.intersect1d(a, b)
        got = alignment.group_cuts(np.diff(a, prepend=0), np.diff(b, prepend=0))
        assert all((g == np.flatnonzero(np.isin(e, both)) + 1).all() for g, e in zip(got, (a, b), strict=True))
    none = np.empty(0, dtype=np.int64)
    assert [len(x) for x in alignment.group_cuts(none, none)] == [0, 0]


def test_wide_groups_are_counted_by_distinct_ids(monkeypatch):
    rnd = np.random.default_rng(3)
    a, b = rnd.integers(0, 9, 900), rnd.integers(0, 7, 700)
    ends = np.array([1, 400, 402, 900]), np.array([300, 301, 699, 700])
    want = alignment.link_pairs(a, b, *ends)
    monkeypatch.setattr(alignment, "WIDE_GROUP", 50)
    got = alignment.link_pairs(a, b, *ends)
    assert all((x == y).all() for x, y in zip(want, got, strict=True))
    assert want[1].sum() == sum(x * y for x, y in zip(np.diff([0, *ends[0]]), np.diff([0, *ends[1]]), strict=True))


def test_both_ways_of_the_byte_level_file_agree(monkeypatch):
    tokens = alignment.ByteLevelTokens(alignment.read_spec(A))
    texts = [" " + t for t in ODD_TEXTS if t]
    quick = [tokens.encode(t) for t in texts]
    monkeypatch.setattr(alignment, "LONG_TEXT", -1)
    assert [x.tolist() for x in quick] == [tokens.encode(t).tolist() for t in texts]


# --- toxicity


def naive_words(text: str):
    """(word, sentence) by plain steps."""
    out, sentence, n, after_stop = [], -1, 0, True
    for m in re.finditer(r"[^\W_]+|[.!?\n\r。！？]", text.lower()):
        if re.fullmatch(r"[.!?\n\r。！？]", m[0]):
            after_stop = True
            continue
        if after_stop or n == toxicity.WINDOW:
            sentence, n, after_stop = sentence + 1, 0, False
        n += 1
        out.append((m[0], sentence))
    return out


def test_reader_finds_words_and_sentences():
    texts = ["Idiot! you are\nLOWEIschaft. " + "word " * 100, "", "...", "Ünïcode 漢字。ok_ok a1?b", "İstanbul x"]
    reader = toxicity.Reader()
    start, end, sentence, owner, features = reader.read(texts)
    joined = "".join(t + "\n" for t in texts)
    shift = np.cumsum([0, *(len(t) + 1 for t in texts)])
    got = defaultdict(list)
    for s, e, n, o in zip(start, end, sentence, owner, strict=True):
        got[int(o)].append((joined[s:e].lower(), int(n)))
        assert shift[o] <= s < e < shift[o + 1]
    for o, t in enumerate(texts[:4]):
        own = got[o]
        first = own[0][1] if own else 0
        assert [(w, n - first) for w, n in own] == naive_words(t)
    # equal prefixes share buckets wherever they stand, other prefixes do not
    low = [reader.read([w])[4] for w in ("loweischaft", "xx loweichen", "lowx")]
    assert low[0][3][0] == -1 or low[0][2][0] == low[1][2][-1] and low[0][1][0] != low[2][0][0]
    assert low[2][1][0] == -1 and low[0][0][0] != low[1][0][-1]


def test_noisy_or_gradient_is_the_slope():
    rnd = np.random.default_rng(5)
    weights, bias = rnd.normal(0, 1, 4), -1.5
    toxic, rest = [1, 0, 1, 0], [2, 0, 0, 3]
    docs = [[[0, 1], [2]], [[3]], [[1, 1, 3], [0], [2, 3]], []]
    kinds = pa.schema([("toxic", pa.int32()), ("rest", pa.int64()), ("sizes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))])
    batch = pa.RecordBatch.from_pydict(
        {"toxic": toxic, "rest": rest, "sizes": [[len(s) for s in d] for d in docs], "features": [[f for s in d for f in s] for d in docs]}, kinds
    )

    def loss(w, b):
        total = 0.0
        for y, r, d in zip(toxic, rest, docs, strict=True):
            clean = math.prod(1 - 1 / (1 + math.exp(-b - sum(w[f] for f in s))) for s in d) * (1 - 1 / (1 + math.exp(-b))) ** r
            total += math.log(1 - clean if y else clean)
        return total

    got = next(toxicity._gradient_batches(bias, weights)(iter([batch])))
    g = got.column(1).to_numpy() / toxicity.SCALE
    step = 1e-5
    for k in range(5):
        up, down = (loss(weights + s * step * (np.arange(4) == k), bias + s * step * (k == 4)) for s in (1, -1))
        assert g[k] == pytest.approx((up - down) / (2 * step), abs=1e-4)


def toxic_corpus(spark, n=600):
    """Clean pseudo-words; a third of the documents hold one bad sentence."""
    rnd = random.Random(8)
    syllables = ["ka", "lo", "mi", "tu", "re", "sa", "no", "vi"]
    word = lambda: "".join(rnd.choices(syllables, k=rnd.randint(1, 4)))
    rows = []
    for i in range(n):
        said = [" ".join(word() for _ in range(rnd.randint(3, 12))) + "." for _ in range(rnd.randint(1, 9))]
        if i % 3 == 0:
            said.insert(rnd.randint(0, len(said)), f"You {rnd.choice(['zgrub', 'zgrubling', 'pwarn'])} {word()}!")
        rows.append((i, " ".join(said), int(i % 3 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int"), rows


def test_offending_sentences_are_found_from_document_labels(spark):
    df, rows = toxic_corpus(spark)
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic").filter("doc_id < 400"))
    got = {r.doc_id: r.score for r in toxicity.score(df.select("doc_id", "text"), model).filter("doc_id >= 400").collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, _, y in rows if i >= 400)
    found = toxicity.locate(df, model).collect()
    texts = {i: t for i, t, _ in rows}
    assert {r.doc_id for r in found} == {i for i, _, y in rows if y}
    assert all(texts[r.doc_id][r.start : r.end] == r.sentence and re.match("You (zgrub|pwarn)", r.sentence) for r in found)
    # the document score is the noisy-or of its sentences
    every = defaultdict(float)
    for r in toxicity.locate(df, model, least=0.0).collect():
        every[r.doc_id] += math.log1p(-r.score) if r.score < 1 else -50
    assert all(-math.expm1(every[i]) == pytest.approx(s, abs=1e-5) for i, s in got.items())


def test_fit_does_not_depend_on_partitions(spark):
    df, _ = toxic_corpus(spark, 150)
    one, two = (toxicity.fit(d, d, rounds=4) for d in (df.coalesce(1), df.repartition(5)))
    assert one.bias == two.bias and (one.weights == two.weights).all() and (one.buckets == two.buckets).all()


def test_toxicity_query_on_held_out_rows(spark):
    """At a thousand documents already most held-out toxic ones, and no clean one."""
    sf = SF_SMALL.replace("sf0.001", "sf0.01")
    rows = queries.op12_toxicity(spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    assert len(rows) == table(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    out = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p for y, p in out if y) >= 0.7 * sum(y for y, _ in out)
    assert sum(p for y, p in out if not y) <= 0.01 * len(out)


def test_toxicity_of_odd_rows(spark):
    df, _ = toxic_corpus(spark, 150)
    model = toxicity.fit(df, df)
    odd = [(1, None), (None, ""), (2, "...\n"), (3, "You zgrub ka!"), (3, "You zgrub ka!"), (4, "ka lo " * 60_000 + "zgrub")]
    docs = spark.createDataFrame([(*r, 9, 9) for r in odd], "doc_id long, text string, score int, t int")
    got = sorted(((r.doc_id or 0, r.score, r.n_sentences) for r in toxicity.score(docs, model).collect()))
    assert [g for g in got if g[0] in (0, 1, 2)] == [(0, 0.0, 0), (1, 0.0, 0), (2, 0.0, 0)]
    assert got[3] == got[4] and got[3][1] > 0.7 and got[5][1] > 0.7 and got[5][2] == -(-120_001 // toxicity.WINDOW)
    # nothing to learn from: no labels, labels of one kind, null labels and ids
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    for labels in (none, df.filter("toxic = 0"), df.limit(0)):
        m = toxicity.fit(df, labels)
        assert not m.fitted and {r.score for r in toxicity.score(docs, m).collect()} == {0.0} and toxicity.locate(docs, m).count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_a_bound_on_labels_takes_a_share(spark):
    df, _ = toxic_corpus(spark, 300)
    n = toxicity.labelled(df, df, "toxic", "doc_id", "text", 100).count()
    assert 70 <= n <= 130 and toxicity.labelled(df, df.union(df), "toxic", "doc_id", "text", 300).count() == 300


# --- vector codes


def want_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """Per row (id, label): code, error, label error; and the codebooks' digest, in plain loops."""
    kept = [(i, lab, [math.floor(scale * float(x)) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    least = {}
    for i, _, v in kept:
        if i is not None:
            least[i] = min(least.get(i, v), v)
    start = [least[i] for i in sorted(least)[:entries]]
    width = -(-len(start[0]) // parts)
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for v in start] for p in range(parts)]
    dist = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    near = lambda x, p: min((dist(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, _, v in kept:
            for p, x in enumerate(cut(v)):
                held[p, near(x, p)[1]].append(x)
        books = [[[sum(c) // len(c) for c in zip(*held[p, k], strict=True)] if (p, k) in held else e for k, e in enumerate(b)] for p, b in enumerate(books)]
    coded = [(i, lab, [near(x, p) for p, x in enumerate(cut(v))]) for i, lab, v in kept]
    of = Counter()
    for _, lab, c in coded:
        of[lab] += sum(d for d, _ in c)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c), of[lab]) for i, lab, c in coded), key=repr), digest


def test_vector_codes_query(spark):
    rows = [tuple(r) for r in table(spark, SF_SMALL, "embeddings").select("vec_id", "embedding", "label").collect()]
    want, digest = want_codes(rows)
    got = queries.op13_vector_codes(spark, SF_SMALL).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == want and {r.codebooks_sha256 for r in got} == {digest}


@pytest.mark.parametrize(("length", "parts", "entries"), [(8, 4, 3), (7, 4, 5), (3, 4, 2)])
def test_codes_of_odd_vectors(spark, length, parts, entries):
    rnd = random.Random(length)
    rows = [(i // 2, [rnd.uniform(-1, 1) for _ in range(length)], [None, 1, 2][i % 3]) for i in range(40)]
    rows += [(None, [0.5] * length, 1), (7, None, 1), (8, [None] + [0.0] * (length - 1), 1), (9, [math.inf] * length, 2), (9, [math.nan] * length, 2)]
    rows += [(50, [900.0] * length, None), (51, [-0.001] * length, 2), (51, [-0.001] * length, 2)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, v int, part int").repartition(3)
    books = vector_codes.fit(df, parts=parts, entries=entries)
    out = vector_codes.with_label_errors(vector_codes.encode(df, books, ["vec_id", "label"]))
    want, digest = want_codes(rows, parts, entries)
    assert sorted((tuple(r) for r in out.select("vec_id", "code", "error", "label_error").collect()), key=repr) == want
    assert books.digest == digest
    # a decoded vector is as far from the coded one as its error says
    back = {(r.vec_id, r.code): (r.vector, r.error) for r in vector_codes.decode(out, books).collect()}
    whole = lambda v: [math.floor(256 * x) for x in v]
    for (_, code), (vector, error) in back.items():
        assert len(vector) == length and error in {sum((a - 256 * b) ** 2 for a, b in zip(whole(v), vector, strict=True)) for v in (r[1] for r in rows) if v and all(x is not None and math.isfinite(x) for x in v)}
        assert len(code) == 2 * parts


def test_codes_of_nothing_and_of_other_lengths(spark):
    kind = "vec_id long, embedding array<float>, label int"
    none = spark.createDataFrame([(1, None, 1)], kind)
    books = vector_codes.fit(none)
    assert vector_codes.encode(none, books, ["vec_id"]).collect() == [] and books.digest == hashlib.sha256(b"").hexdigest()
    mixed = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0], 1), (None, [], 2), (3, [3e38, -3e38], 2)], kind)
    books = vector_codes.fit(mixed, parts=2)
    out = vector_codes.with_label_errors(vector_codes.encode(mixed, books, ["vec_id", "label"]))
    got = {r.vec_id: (r.code, r.error) for r in out.collect()}
    assert got[1] == ("0000", 0) and got[2] == got[None] == (None, None) and got[3] == ("0101", 0)
    only = spark.createDataFrame([(None, [1.0], 1)], kind)
    assert [r.code for r in vector_codes.encode(only, vector_codes.fit(only), ["vec_id"]).collect()] == [None]
