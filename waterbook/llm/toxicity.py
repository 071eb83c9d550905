"""Toxicity by multiple-instance learning: labels of documents, scores of sentences.

A sentence has a log-odds, the bias plus the weights of its words' features:
the whole lower-cased word and its first 4, 5 and 6 code points, hashed to
``1 << BITS`` buckets. The sentences' probabilities make that of their document
by noisy-or: a document is toxic unless every sentence is clean,
``1 - prod(1 - p)``. Only documents are labelled; the gradient of the noisy-or
gives every sentence of a toxic document the share ``p / P`` of the blame, so
training finds the offending sentences by itself, and ``locate`` returns them.

Fitting, all in Spark: one pass counts in how many toxic and clean labelled
documents each bucket occurs. Buckets that toxic documents hold significantly
more often (a likelihood-ratio test) may carry a weight, which starts from the
log-odds of those counts: else a word that always stands beside a stronger one
would get none, as the noisy-or has no blame left for it. A second pass stores
the labelled documents' sentences that hold such a bucket, and the number of
the others, which all have the bias alone. Each round then adds up gradient
and curvature per bucket, in whole millionths, so no order changes a sum, and
takes a damped Newton step on each weight.

A sentence ends at ``. ! ?`` (also full-width) or a line end; one of more than
``WINDOW`` words is cut every ``WINDOW`` words, so that text without
punctuation has places too.

``max_labelled`` bounds the labelled documents used: beyond it, those with the
smallest hashes of their ids, about as many. Everything else covers all rows.

Defined results: null, empty and wordless texts have no sentence and score 0.
Rows are scored one by one, so repeated rows and null ids are no special case.
An id labelled repeatedly is toxic if any of its labels says so; null labels
and null ids teach nothing; copies of a document each count. Without a toxic
and a clean labelled document nothing is learned and every score is 0. Extra
columns are ignored; long texts are scored whole, in pieces of rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BITS, PREFIXES, WINDOW = 20, (4, 5, 6), 40
SCALE = 1_000_000

#: Characters of a chunk of texts handled at once (or of one text).
CHUNK = 1_000_000

#: Ends of sentences (fixed values).
STOPS = ".!?\n\r  。！？"


@dataclass(frozen=True)
class ToxicityModel:
    """Bias and the weights of the buckets that have one."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray

    @property
    def fitted(self) -> bool:
        return bool(np.isfinite(self.bias))


NOTHING_LEARNED = ToxicityModel(float("-inf"), np.empty(0, dtype=np.int64), np.empty(0))


class Reader:
    """Words, features and sentences of chunks of texts."""

    def __init__(self):
        self.kind = np.zeros(0x110000, dtype=np.uint8)  # 0 not seen, 1 of a word, 2 a stop, 3 other
        for c in STOPS:
            self.kind[ord(c)] = 2
        self.power = self.inverse = np.empty(0, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            base = 0x9E3779B97F4A7C15
            for name, x in (("power", base), ("inverse", pow(base, -1, 1 << 64))):
                steps = np.full(n, x, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def read(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Of the texts' words: start, end, sentence (numbered through) and
        text; and their features, a row per kind, -1 where a word has none.
        Places count through the texts, each followed by a line end."""
        low = [t.lower() if t.isascii() or len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts]
        code = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le"), dtype=np.uint32)
        kind = self.kind[code]
        if not kind.all():
            for c in np.unique(code[kind == 0]).tolist():
                self.kind[c] = 1 if unicodedata.category(chr(c))[0] in "LMN" else 3
            kind = self.kind[code]
        inside = np.concatenate([[False], kind == 1, [False]])
        start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), start, side="right")
        stops = np.cumsum(kind == 2, dtype=np.int32)[start]
        new = np.ones(len(start), dtype=bool)
        new[1:] = stops[1:] != stops[:-1]
        first = np.flatnonzero(new)
        place = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start))))
        sentence = np.cumsum(place % WINDOW == 0) - 1
        # a word's hash is a polynomial over its code points, by running sums
        self._powers(len(code))
        sums = np.zeros(len(code) + 1, dtype=np.uint64)
        np.cumsum(code.astype(np.uint64) * self.power[: len(code)], out=sums[1:])
        back = self.inverse[start]
        features = np.full((1 + len(PREFIXES), len(start)), -1, dtype=np.int64)
        for row, size in enumerate((0, *PREFIXES)):
            h = (sums[np.minimum(start + size, end) if size else end] - sums[start]) * back + np.uint64(row)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            bucket = (h >> np.uint64(64 - BITS)).astype(np.int64)
            features[row] = bucket if not size else np.where(end - start > size, bucket, -1)
        return start, end, sentence, owner, features


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int, list[str]]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < CHUNK or end == at):
            size += len(texts[end] or "")
            end += 1
        yield at, end, [t or "" for t in texts[at:end]]
        at = end


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, toxic, clean): how many of a task's documents hold a bucket."""
    reader = Reader()
    held = np.zeros((2, 1 << BITS), dtype=np.int64)
    for batch in batches:
        toxic, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        for at, _, part in chunks(texts):
            _, _, _, owner, features = reader.read(part)
            bucket, doc = features.ravel(), np.tile(owner, len(features))
            once = np.unique((doc << BITS | bucket)[bucket >= 0])
            np.add.at(held, (toxic[at + (once >> BITS)], once & (1 << BITS) - 1), 1)
    used = np.flatnonzero(held.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[1][used]), pa.array(held[0][used])], ["bucket", "toxic", "clean"])


def _evidence_batches(buckets: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        place = np.full((1 << BITS) + 1, -1, dtype=np.int64)  # the last for words without the feature
        place[buckets] = np.arange(len(buckets))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, end, part in chunks(texts):
                _, _, sentence, owner, features = reader.read(part)
                of = np.zeros(int(sentence[-1]) + 1 if len(sentence) else 0, dtype=np.int64)
                of[sentence] = owner
                found = place[features]
                hit = np.nonzero(found >= 0)
                s, f = sentence[hit[1]], found[hit]
                order = np.lexsort((f, s))
                s, f = s[order], f[order]
                named, size = np.unique(s, return_counts=True)
                docs = end - at
                rest = np.bincount(of, minlength=docs) - np.bincount(of[named], minlength=docs)
                cut = np.searchsorted(of[named], np.arange(docs + 1))
                edge = np.append(0, np.cumsum(size))[cut]
                columns = [batch.column(0).slice(at, docs), pa.array(rest)]
                columns += [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(size, pa.int32()))]
                columns += [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(f, pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["toxic", "rest", "sizes", "features"])

    return run


def _gradient_batches(bias: float, weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(feature, g, h): gradient and curvature in whole millionths; the
    feature after the last is the bias."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h = np.zeros((2, len(weights) + 1), dtype=np.int64)
        whole = lambda x: np.rint(x * SCALE).astype(np.int64)
        for batch in batches:
            toxic, rest = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            n = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            size, feature = (batch.column(i).flatten().to_numpy() for i in (2, 3))
            of, sentence = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(size)), size)
            logit = bias + np.bincount(sentence, weights=weights[feature], minlength=len(size))
            p, p0 = 1 / (1 + np.exp(-logit)), 1 / (1 + np.exp(-bias))
            clean = np.bincount(of, weights=-np.logaddexp(0, logit), minlength=len(n)) + rest * np.log1p(-p0)
            any_one = np.maximum(-np.expm1(clean), 1e-12)
            share = lambda x, doc: np.where(toxic[doc] == 1, x / any_one[doc], 0) - x
            gs, hs = whole(share(p, of)), whole(p * (1 - p))
            np.add.at(g, feature, gs[sentence])
            np.add.at(h, feature, hs[sentence])
            docs = np.arange(len(n))
            g[-1] += gs.sum() + (whole(share(np.full(len(n), p0), docs)) * rest).sum()
            h[-1] += hs.sum() + whole(np.array(p0 * (1 - p0))) * rest.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(g))), pa.array(g), pa.array(h)], ["feature", "g", "h"])

    return run


def labelled(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, max_labelled: int) -> DataFrame:
    """(toxic, t) of the labelled documents. About ``max_labelled`` labels at
    most, each id once, are joined, which is what bounds the broadcast."""
    known = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).filter("k is not null and y is not null")
    known = known.groupBy("k").agg(F.max((F.col("y") > 0).cast("int")).alias("toxic"))
    n = known.count()
    if n > max_labelled:
        known = known.filter(F.pmod(F.xxhash64("k"), F.lit(SCALE)) < int(SCALE * max_labelled / n))
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    return rows.join(F.broadcast(known), "k").select("toxic", F.coalesce("t", F.lit("")).alias("t"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    key: str = "doc_id",
    text: str = "text",
    max_labelled: int = 200_000,
    least_documents: int = 3,
    least_evidence: float = 16.0,
    rounds: int = 20,
    damping: float = 2.0,
    ridge: float = 0.02,
) -> ToxicityModel:
    """Learn from the documents that ``labels`` names. A bucket needs
    ``least_documents`` toxic documents and a likelihood ratio of
    ``least_evidence`` (twice the log) to carry a weight."""
    rows = labelled(docs, labels, label, key, text, max_labelled)
    counted = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = counted.get(1, 0), counted.get(0, 0)
    if not n1 or not n0:
        return NOTHING_LEARNED
    found = rows.mapInArrow(_count_batches, "bucket bigint, toxic bigint, clean bigint").groupBy("bucket").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    a, b = F.col("a"), F.col("b")
    share = (a + b) / F.lit(n1 + n0)
    term = lambda k, n, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    ratio = 2 * (term(a, n1, share) + term(n1 - a, n1, 1 - share) + term(b, n0, share) + term(n0 - b, n0, 1 - share))
    chosen = found.filter((a >= least_documents) & (a * n0 > b * n1) & (ratio >= least_evidence)).toPandas().sort_values("bucket")  # at most 1 << BITS rows
    buckets = chosen["bucket"].to_numpy(np.int64)
    kinds = "toxic int, rest bigint, sizes array<int>, features array<int>"
    evidence = stored(rows.mapInArrow(_evidence_batches(buckets), kinds), "toxicity")
    odds = [(chosen[c].to_numpy(np.float64) + 0.5) / n for c, n in (("a", n1), ("b", n0))]
    weights, bias = np.round(np.log(odds[0] / odds[1]), 9), round(float(np.log(n1 / (n1 + n0) / 20)), 9)
    for _ in range(rounds):
        got = evidence.mapInArrow(_gradient_batches(bias, weights), "feature bigint, g bigint, h bigint")
        got = got.groupBy("feature").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas().set_index("feature").sort_index()
        g, h = got["g"].to_numpy() / SCALE, got["h"].to_numpy() / SCALE
        step = np.clip((g - ridge * np.append(weights, 0.0)) / (damping * h + ridge), -2, 2)
        weights, bias = np.round(weights + step[:-1], 9), round(bias + float(step[-1]), 9)
    return ToxicityModel(bias, buckets, weights)


class Scorer:
    """Sentence log-odds of texts under a model."""

    def __init__(self, model: ToxicityModel):
        self.reader, self.bias = Reader(), model.bias
        self.weight = np.zeros((1 << BITS) + 1)
        self.weight[model.buckets] = model.weights

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Text, first and last place, and log-odds of every sentence."""
        start, end, sentence, owner, features = self.reader.read(texts)
        n = int(sentence[-1]) + 1 if len(sentence) else 0
        logit = self.bias + np.bincount(sentence, weights=self.weight[features].sum(axis=0), minlength=n)
        first = np.flatnonzero(np.diff(sentence, prepend=-1))
        last = np.append(first[1:], len(sentence)) - 1 if n else first
        return owner[first], start[first], end[last], logit


def _score_batches(model: ToxicityModel, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, end, part in chunks(texts):
                owner, _, _, logit = scorer.sentences(part)
                clean = np.bincount(owner, weights=-np.logaddexp(0, logit), minlength=end - at)
                score = np.round(-np.expm1(clean), 9) + 0.0
                n = np.bincount(owner, minlength=end - at)
                columns = [batch.column(0).slice(at, end - at), pa.array(score), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, [key, "score", "n_sentences"])

    return run


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, n_sentences) of every whole text."""
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("t"))
    if not model.fitted:
        return rows.select(key, F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("n_sentences"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(_score_batches(model, key), f"`{key}` {kind}, score double, n_sentences bigint")


def _locate_batches(model: ToxicityModel, key: str, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, _, part in chunks(texts):
                owner, start, end, logit = scorer.sentences(part)
                p = np.round(1 / (1 + np.exp(-logit)), 9)
                hit = np.flatnonzero(p >= least)
                base = np.cumsum([0, *(len(t) + 1 for t in part)])[owner[hit]]
                first, last = start[hit] - base, end[hit] - base
                said = [part[o][x:y] for o, x, y in zip(owner[hit].tolist(), first.tolist(), last.tolist(), strict=True)]
                keys = batch.column(0).take(pa.array(at + owner[hit]))
                yield pa.RecordBatch.from_arrays([keys, pa.array(first), pa.array(last), pa.array(said, pa.string()), pa.array(p[hit])], [key, "start", "end", "sentence", "score"])

    return run


def locate(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(key, start, end, sentence, score) of the sentences whose own
    probability is ``least`` or more; places are code points of the text."""
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("t"))
    kind = rows.schema[0].dataType.simpleString()
    kinds = f"`{key}` {kind}, start bigint, end bigint, sentence string, score double"
    if not model.fitted:
        return rows.limit(0).mapInArrow(lambda batches: iter(()), kinds)
    return rows.mapInArrow(_locate_batches(model, key, least), kinds)


def held_out(key: Column) -> Column:
    """Ids kept out of learning: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(3)) == 1, F.lit(False))
