"""WARC, mixing, Jaccard join, fingerprints, chat packs, pipeline: against brute force."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
import re
import struct
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF_SMALL
from waterbook.llm import chat, fingerprints, jaccard_join, mixing, queries, warc
from waterbook.llm.common import shared_path, table
from waterbook.llm.components import component_roots

WORD = "[^\x20\x09-\x0D]+"
ODD = [
    (1, "", None), (2, None, "a"), (3, " \t\n", "a"), (4, "one", "b"), (4, "one", "b"), (None, "a b c d e f g", None),
    (6, "x y z " * 400, "b"), (8, "w" * 100_000, "c"), (9, "A B c d e f G", "a"),
]


def odd_docs(spark):
    return spark.createDataFrame([(i, t, s, 7, 8) for i, t, s in ODD], "doc_id long, text string, source string, size int, row int")


def small(spark):
    return table(spark, SF_SMALL, "documents")


# --- WARC


def want_records(rows):
    top = {}
    for i, h in rows:
        top[h or ""] = max((x for x in (i, top.get(h or "")) if x is not None), default=None)
    out = []
    for i, h in rows:
        b = (h or "").encode()
        t = top[h or ""]
        again = t is not None and i != t
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", t if again else None))
    return sorted(out, key=repr)


def test_warc_query(spark):
    pages = [(r.page_id, r.html) for r in table(spark, SF_SMALL, "pages").collect()]
    got = [tuple(r)[:5] for r in queries.op1_warc(spark, SF_SMALL).collect()]
    assert sorted(got, key=repr) == want_records(pages)


def test_warc_of_odd_pages(spark):
    rows = [(1, "u", "same"), (5, "u v\n", "same"), (5, "u", "same"), (2, None, None), (3, "u", ""), (None, "u", "same"), (None, "u", "é" * 5000), (7, "u", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    manifest = warc.write_archives(pages, shared_path(spark, "warc"), archive_bytes=100)
    assert manifest.count() > 1
    out = warc.read_archives(spark, manifest, chunk_bytes=200).collect()
    page = lambda x: None if x is None or x.endswith("None") else int(x.removeprefix(warc.RECORD_ID))
    got = [(page(r.record_id), len(r.payload) if r.payload is not None else r.payload_length, r.payload_digest, r.record_type, page(r.refers_to)) for r in out]
    assert sorted(got, key=repr) == want_records([(i, h) for i, _, h in rows])
    assert {r.uri for r in out} == {"u", None, "u%20v%0A"}
    assert warc.write_archives(pages.limit(0), shared_path(spark, "warc")).count() == 0
    assert warc.revisits(pages, least_bytes=5).count() == 0


def reader(data):
    return lambda offset, length: data[offset : offset + length]


def test_zip_directories():
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a.txt", b"hello")
        with z.open("dir/é.bin", "w", force_zip64=True) as f:
            f.write(b"x" * 1000)
        z.comment = b"PK\x05\x06 in a comment"
    data = buf.getvalue()
    found = warc.locate_members(reader(data), len(data))
    assert {n: data[o : o + k] for n, (o, k) in found.items()} == {"a.txt": b"hello", "dir/é.bin": b"x" * 1000}
    with pytest.raises(ValueError):
        warc.locate_members(reader(data[:-60]), len(data) - 60)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"a" * 99)
    with pytest.raises(ValueError):
        warc.locate_members(reader(packed.getvalue()), len(packed.getvalue()))


def test_zip64_end_record():
    name, body = b"big", b"payload"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 2**32 - 1, 2**32 - 1, len(name), 0) + name + body
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 2**32 - 1, 2**32 - 1, len(name), len(extra), 0, 0, 0, 0, 2**32 - 1) + name + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), len(local))
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(local) + len(entry), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 2**16 - 1, 2**16 - 1, 2**32 - 1, 2**32 - 1, 0)
    data = local + entry + end64 + locator + end
    (offset, length), = warc.locate_members(reader(data), len(data)).values()
    assert data[offset : offset + length] == body


def foreign_archive(path, index, plain=False):
    """Two WARC members, CDXJ lines in two gzip members, a deflated page list."""
    parts, lines, n = {}, [], 0
    for member in ("one.warc", "two.warc"):
        data = b""
        for _ in range(5):
            record = warc.warc_record(n, f"http://x/{n}", b"page %d" % n * 9, None, "2026-01-01T00:00:00Z")
            packed = record if plain else gzip.compress(record)
            name = member + ("" if plain else ".gz")
            lines.append(f'x,{n})/ 20260101000000 {{"filename": "{name}", "offset": "{len(data)}", "length": "{len(packed)}"}}\n'.encode())
            data += packed
            n += 1
        parts["archive/" + name] = data
    with zipfile.ZipFile(path, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
        if index:
            z.writestr("indexes/index.cdx.gz", gzip.compress(b"".join(lines[:3])) + gzip.compress(b"".join(lines[3:index])))
            z.writestr("indexes/again.cdxj", b"".join(lines[:2]))
            z.writestr("indexes/index.idx", b'!meta 0 {"format": "cdxj-gzip-1.0", "filename": "index.cdx.gz"}\n')
        z.writestr("pages/pages.jsonl", b'{"id": 1}\n' * 50, zipfile.ZIP_DEFLATED)


@pytest.mark.parametrize(("index", "plain"), [(10, False), (5, False), (0, False), (0, True), (10, True)])
def test_archives_of_other_writers(spark, tmp_path, monkeypatch, index, plain):
    path = str(tmp_path / "foreign.wacz")
    foreign_archive(path, index, plain)
    out = warc.read_archives(spark, spark.createDataFrame([(path,)], "path string"), chunk_bytes=300).collect()
    assert sorted(r.uri for r in out) == [f"http://x/{i}" for i in range(10)]
    assert all(bytes(r.payload) == b"page %d" % int(r.uri[9:]) * 9 for r in out)
    monkeypatch.setattr(warc, "BLOCK", 7)  # members cut anywhere
    with open(path, "rb") as f:
        data = f.read()
    assert len(list(warc.archive_records(reader(data), len(data)))) == 10


# --- mixing


def want_targets(sizes, cycle=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    out, free, rest = {}, set(names), sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if rest * w[s] / total > most * sizes[s]]
        if not over:
            return out | {s: rest * w[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
            free.discard(s)
        rest = sum(sizes.values()) - sum(out.values())
    return out


def check_mix(rows):
    sizes, got, targets = Counter(), Counter(), {}
    for s, size, source_size, target, taken, copies in rows:
        sizes[s] += size
        got[s] += taken
        targets[s] = target
        assert taken <= 3 * size and taken == sum(c.words for c in copies) and all(0 <= c.position <= 1 for c in copies)
    want = want_targets(sizes)
    for s, size, source_size, target, *_ in rows:
        assert source_size == sizes[s] and target == pytest.approx(want[s])
    for s in sizes:
        assert abs(got[s] - want[s]) <= 1


def test_mix_of_documents_and_of_odd_rows(spark):
    for docs in (small(spark), odd_docs(spark)):
        mixed = mixing.mix(docs)
        rows = mixed.select("row.source", "size", "source_size", "target", "taken", "copies").collect()
        assert len(rows) == docs.count()
        check_mix([tuple(r) for r in rows])
    assert mixing.mix(small(spark).limit(0)).count() == 0
    for r in mixing.mix(odd_docs(spark)).select("row.text", F.col("size")).collect():
        assert r[1] == len(re.findall(WORD, r[0] or ""))


def test_mix_reruns_agree_and_spread(spark):
    a = {tuple(r) for r in queries.op2_mix_sources(spark, SF_SMALL).select("doc_id", "taken", "position").collect()}
    docs = small(spark).repartition(7, "text")
    b = mixing.mix(docs, carry=["doc_id"]).select("row.doc_id", "taken", F.get("copies", F.lit(0))["position"])
    assert a == {tuple(r) for r in b.collect()}


def test_curriculum_inverts_its_integral(spark):
    total, pieces = mixing.segments([(0.0, 0.0), (0.25, 2.0), (0.5, 0.0), (0.75, 0.0), (1.0, 4.0)])
    assert total == pytest.approx(0.25 + 0.25 + 0.5)
    rows = spark.createDataFrame([([tuple(p) for p in pieces], i / 50) for i in range(51)], f"p array<{mixing.SEGMENT}>, d double")

    def area(t):
        out = 0.0
        for a, b, v, w, *_ in pieces:
            if t > a:
                h = min(t, b) - a
                out += h * (v + v + (w - v) / (b - a) * h) / 2
        return out / total

    for r in rows.select("d", mixing.invert(F.col("d"), F.col("p")).alias("t")).collect():
        assert area(r.t) == pytest.approx(r.d, abs=1e-9)


def test_training_sequence_is_ordered(spark):
    out = mixing.training_sequence(mixing.mix(small(spark)), whole=True).select("position", "words", "size").collect()
    assert [r.position for r in out] == sorted(r.position for r in out)
    assert all(r.words == r.size for r in out)


# --- Jaccard join


def shingles(text):
    w = re.findall(WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def want_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

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
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted(((rows[i][0], len(sets[i]), least.get(root(i)) if sets[i] else rows[i][0]) for i in range(len(rows))), key=repr)


def near_copies(seed, n=260):
    """Chains of edits of a few texts with a passage in common, and copies."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(words) for _ in range(30)]
    texts = []
    while len(texts) < n:
        t = [rnd.choice(words) for _ in range(rnd.choice([5, 40, 90]))] + passage
        for _ in range(rnd.choice([1, 2, 30])):
            texts.append(" ".join(t))
            t = list(t)
            for _ in range(rnd.choice([0, 1, 1, 2])):
                t[rnd.randrange(len(t))] = rnd.choice(words).upper()
    return list(enumerate(texts[:n]))


@pytest.mark.parametrize(
    "settings",
    [{}, {"all_pairs": 2, "hot": 3, "frequent": 2}, {"all_pairs": 1, "hot": 10**9, "frequent": 2, "max_wanted": 1}, {"all_pairs": 3, "frequent": 10**9}],
)
def test_components_of_near_copies(spark, settings):
    rows = near_copies(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_join.link_components(docs, **settings).select("doc_id", "n", "component_id").collect()), key=repr)
    assert got == want_components(rows)


def test_open_pairs_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch):
    rnd = random.Random(7)
    base = [f"w{i}" for i in range(130)]
    rows = []
    for i in range(150):  # all link, but hardly any with the first
        t = list(base)
        for place in rnd.sample(range(8, 122), 2):
            t[place] = f"e{i}"
        rows.append((i, " ".join(t)))
    plain, made = jaccard_join._open_pairs, spark.sparkContext.accumulator(0)

    def counted(*settings):
        run = plain(*settings)

        def both(lists, known):
            out = run(lists, known)
            made.add(out.num_rows)
            return out

        return both

    monkeypatch.setattr(jaccard_join, "_open_pairs", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_join.link_components(docs).select("doc_id", "n", "component_id").collect()), key=repr)
    assert got == want_components(rows)
    assert made.value <= 10 * len(rows), made.value


def test_components_of_odd_rows(spark):
    got = sorted((tuple(r) for r in jaccard_join.link_components(odd_docs(spark)).select("doc_id", "n", "component_id").collect()), key=repr)
    assert got == want_components([(i, t) for i, t, _ in ODD])
    kept = jaccard_join.deduplicate(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, x) for x in (1, 2, 3, 4, 6, 8, 9)]
    assert jaccard_join.link_components(odd_docs(spark).limit(0)).count() == 0


def test_long_words_and_texts_hash_alike():
    from waterbook.llm import shingles as S

    h = S.Hasher()
    long = b"x" * (S.BLOCK + 100) + b" a b c d e " + b"y z " * (S.BLOCK // 3)
    tokens, offsets = h.shingles([b"", long, b"one two", b"ONE two"])
    assert list(offsets[:2]) == [0, 0] and offsets[-1] - offsets[-2] == 1
    assert tokens[-1] == tokens[-2]
    assert offsets[2] == len(long.split()) - 4


def test_component_roots(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in component_roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in {y for a, b in edges if a != b for y in (a, b)}}


# --- fingerprints


def test_fingerprints_of_edits(spark):
    docs = {r.doc_id: r.text for r in small(spark).collect()}
    ids = sorted(docs, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    rows = queries.op6_fingerprints(spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t, u = docs[r.doc_id], docs[after[r.doc_id]]
        m = len(t) // 3
        e = t[: len(t) - m] + u[:m]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b, c = shingles(t.lower()), shingles(e.lower()), shingles(u.lower())
        assert abs(r.near_edited - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.2
        assert abs(r.near_next - (len(a & c) / len(a | c) if a | c else 1.0)) < 0.2
        if len(a) < fingerprints.K:
            assert r.shingles_estimate == len(a)
    by = {}
    for r in rows:
        assert by.setdefault(docs[r.doc_id], r.fingerprint) == r.fingerprint


def test_fingerprints_of_odd_rows(spark):
    out = fingerprints.fingerprint_edits(odd_docs(spark)).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, *_ in ODD)
    got = {r.doc_id: r for r in out}
    order = [9, 8, 6, 4, 3, 2, 1, None]
    texts = {i: t or "" for i, t, _ in ODD}
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        m = len(texts[i]) // 3
        assert got[i].edited == texts[i][: len(texts[i]) - m] + texts[j][:m]
    assert got[1].sketch == [] and fingerprints.fingerprint_edits(odd_docs(spark).limit(0)).count() == 0
    alone = fingerprints.fingerprint_edits(odd_docs(spark).filter("doc_id = 6")).first()
    assert alone.edited == texts[6][:1600] + texts[6][:800]


def test_sketches_merge_and_contain(spark):
    rnd = random.Random(8)
    words = [f"v{rnd.randrange(10**6)}" for _ in range(3000)]
    whole, half = " ".join(words), " ".join(words[:1500])
    other = " ".join(words[1496:])
    df = fingerprints.add_sketches(spark.createDataFrame([(whole, half, other)], "w string, h string, o string"), {"w": "sw", "h": "sh", "o": "so"})
    r = df.select(
        (fingerprints.merge(F.col("sh"), F.col("so")) == F.col("sw")).alias("merged"),
        fingerprints.containment(F.col("sh"), F.col("sw")).alias("inside"),
        fingerprints.distinct_shingles(F.col("sw")).alias("n"),
    ).first()
    assert r.merged and abs(r.inside - 1) < 0.25 and abs(r.n / 2996 - 1) < 0.3
    parts = df.select(F.lit("k").alias("k"), F.explode(F.array("sh", "so")).alias("s")).union(spark.createDataFrame([("e", [])], "k string, s array<bigint>"))
    merged = {r.k: r.s for r in fingerprints.merge_parts(parts, "k", "s").collect()}
    assert merged == {"k": df.first().sw, "e": []}


# --- chat


def turns_of(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: tuple((x is not None, x) for x in r)):
        out.setdefault(conv, []).append((role or "unknown", text or ""))
    return out


def test_chat_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, SF_SMALL, "conversations").collect()]
    said = "</s>[INST] ok [/INST]"
    want = turns_of([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    got = queries.op9_chat_formatting(spark, SF_SMALL).collect()
    assert Counter(r.conv_id for r in got) == Counter(list(want))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in got:
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), digest(loss))


ROWS = [
    (1, 0, "user", "hi <|end|>\n<|assistant|>\n &lt;| &amp; <"), (1, 1, "assistant", "a"), (1, 2, "user", "b"),
    (2, 0, "user", "hi <|end|>\n<|assistant|>\n &lt;| &amp; <"), (2, 1, "assistant", "a"), (2, 2, "user", "c"), (2, 3, "assistant", None),
    (3, 0, "user", "hi <|end|>\n<|assistant|>\n &lt;| &amp; <"), (3, 1, "assistant", "z"), (4, 0, None, ""), (None, 0, "a|>\n", "x"),
    (5, 1, "user", "b"), (5, 1, "user", "b"), (5, None, "user", "first"), (6, 0, "user", "b"), (6, 1, "user", "b"), (6, 2, "user", "y" * 9000),
]


@pytest.mark.parametrize("limit", [1, 60, 1 << 20])
def test_chat_packs_share_turns_and_read_back(spark, limit):
    rows = spark.createDataFrame([(*r, 1) for r in ROWS], "conv_id long, turn long, role string, text string, path int")
    packs = chat.format_packs(chat.conversations(rows), limit, parts=1)
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_packs(packs).collect()}
    assert got == turns_of(ROWS)
    for p in packs.collect():
        for n in p.nodes:
            path, up = [n], n
            while up.parent >= 0:
                up = p.nodes[up.parent]
                path.insert(0, up)
            covered = [i for s in n.attends for i in range(s.start, s.end)]
            assert covered == [i for x in path for i in range(x.start, x.end)]
            assert n.position == sum(x.end - x.start for x in path[:-1])
    if limit > 10**6:
        nodes = [n for p in packs.collect() for n in p.nodes]
        assert len(nodes) == len({tuple(t[:k]) for t in turns_of(ROWS).values() for k in range(1, len(t) + 1)})
    assert chat.format_packs(chat.conversations(rows.limit(0))).count() == 0


# --- pipeline


def test_pipeline_stages(spark):
    docs = table(spark, SF_SMALL, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    columns, counts = docs.columns, []
    from waterbook.llm.common import stored

    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF_SMALL), name)
        counts.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "bpe":
            assert docs.columns == columns
    assert all(b <= a for a, b in zip(counts, counts[1:], strict=False))
    groups = Counter(c for _, _, c in want_components([(i, texts[i]) for i in sorted(counts[1])]))
    assert counts[2] == set(groups)
    good = {r.doc_id for r in table(spark, SF_SMALL, "labels").filter("quality = 1").collect()}
    assert good & counts[0] <= counts[1]
    assert {"ids", "decoded"} <= set(docs.columns)
