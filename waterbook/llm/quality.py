"""Quality rules: counted text rules and an n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed token unigrams and bigrams:
one of trusted target documents, one of the whole raw corpus. Tokens are whole
runs of letters and digits, or of anything else that is not white space. A
document's score is the mean of ``log p_target - log p_raw`` over its unigrams
and bigrams, in whole millionths so that sums never depend on an order. It is
kept when no counted rule fails and the score reaches the threshold, the same
for every document.

Defined results: a null or empty text has no words, fails the base rules and
scores 0. Rows are judged one by one, so repeated rows get equal verdicts and
null ids are no special case. With no trusted document all weights are 0 and
the threshold is 0: the base rules alone decide. Extra columns are ignored by
``apply`` and carried by ``filter_documents``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, exact_quantile, pack, sealed, stored, words

#: Runs of letters and digits, or of anything else that is not white space.
TOKEN = r"[\p{L}\p{M}\p{N}]++|[^\p{L}\p{M}\p{N}\x20\x09-\x0D]++"
SYMBOLS = r"[#*$%&|<>]"
SCALE = 1_000_000


@dataclass(frozen=True)
class QualityModel:
    """Bucket weights in millionths and the least score that is kept."""

    weights: tuple[int, ...]
    threshold: float


def token_hashes(text: Column) -> Column:
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.transform(tokens, lambda x: F.xxhash64(x))


def _bucket(h: Column, buckets: int) -> Column:
    rest = F.pmod(h, F.lit(buckets)) if buckets & (buckets - 1) else h.bitwiseAND(F.lit(buckets - 1).cast("bigint"))
    return rest.cast("int")


def _bigrams(h: Column, of) -> Column:
    """``of`` the hash of each two tokens in a row."""
    n = F.greatest(F.size(h), F.lit(1))
    return F.zip_with(F.slice(h, 1, n - 1), F.slice(h, 2, n), lambda a, b: of(F.xxhash64(a, b)))


def grams(h: Column, buckets: int) -> Column:
    """Buckets of the unigrams and bigrams of a column of token hashes."""
    return F.concat(F.transform(h, lambda x: _bucket(x, buckets)), _bigrams(h, lambda x: _bucket(x, buckets)))


def _score(h: Column, model: QualityModel) -> Column:
    """Mean weight of the grams of a column of token hashes; null without any."""
    weights = model.weights
    table = F.expr(f"cast(split('{','.join(map(str, weights))}', ',') as array<bigint>)")
    weight = lambda x: F.get(table, _bucket(x, len(weights)))
    total = F.aggregate(h, F.lit(0).cast("bigint"), lambda acc, x: acc + weight(x))
    total = F.aggregate(_bigrams(h, weight), total, lambda acc, w: acc + w)
    return F.when(F.size(h) > 0, total / (2 * F.size(h) - 1) / SCALE)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_counts(df: DataFrame, text: str, keep: list[str], extra: dict[str, Column] | None = None, hashes: Column | None = None) -> DataFrame:
    """``keep`` columns and the counted rules of every whole text; ``extra``:
    further columns, made of the words column ``w`` and of ``g``, the ``hashes``.

    ``n_repeat_words``: positions covered by 3-word windows that occur at
    least twice. Windows are compared by a 64-bit hash. A text without a
    repeated window stops at a distinct count; up to 16 repeated windows are
    looked up in a list; beyond that windows are sorted with their positions,
    so no text costs more than n log n. Each select makes the columns that the
    next one's lambdas index.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    df = df.select(*keep, words(t).alias("w"), F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("l"), *([] if hashes is None else [hashes.alias("g")]))
    extra = extra or {}
    keep = [*keep, *extra]
    df = df.select(
        *keep[: len(keep) - len(extra)],
        *[c.alias(name) for name, c in extra.items()],
        F.size("w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    keep = [*keep, *COUNTS[:4]]
    shifted = lambda c, fill: F.slice(c, 2, F.greatest(F.size(c), F.lit(fill)))
    windows = F.transform(F.slice("h", 1, F.greatest(F.size("h") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(F.col("h"), i + 1), F.get(F.col("h"), i + 2)))
    df = df.select(*keep, windows.alias("v"))
    ordered = F.sort_array("v")
    same = F.zip_with(ordered, shifted(ordered, 1), lambda a, b: F.when(a == b, a))
    none = F.array().cast("array<bigint>")
    twice = F.when(F.size(F.array_distinct("v")) < F.size("v"), F.array_distinct(F.filter(same, lambda x: x.isNotNull()))).otherwise(none)
    df = df.select(*keep, "v", twice.alias("d"))
    placed = F.transform("v", lambda x, i: F.struct(x.alias("v"), i.alias("p")))
    few = F.transform(F.filter(placed, lambda e: F.array_contains(F.col("d"), e["v"])), lambda e: e["p"])
    s = F.sort_array(placed)
    before = F.concat(F.array(F.lit(None).cast("struct<v:bigint,p:int>")), s)
    near = F.arrays_zip(s.alias("x"), before.alias("y"), shifted(s, 1).alias("z"))
    again = F.filter(near, lambda e: F.coalesce(e["x"]["v"] == e["y"]["v"], F.lit(False)) | F.coalesce(e["x"]["v"] == e["z"]["v"], F.lit(False)))
    many = F.sort_array(F.transform(again, lambda e: e["x"]["p"]))
    places = F.when(F.size("d") == 0, F.array().cast("array<int>")).when(F.size("d") <= 16, few).otherwise(many)
    df = df.select(*keep, places.alias("p"))
    gaps = F.zip_with("p", shifted(F.col("p"), 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    covered = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return df.select(*keep, covered.alias("n_repeat_words"))


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    n = F.col("n_words")
    return (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * n)


def fit(
    docs: DataFrame,
    trusted: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    buckets: int = 16384,
    max_broadcast: int = 2_000_000,
    smoothing: float = 1.0,
    quantile: float = 0.002,
    margin: float = 0.25,
) -> QualityModel:
    """Count both multinomials over all documents.

    ``trusted`` lists the ids of target documents, all of which make the
    target; up to ``max_broadcast`` ids are broadcast, more are joined. Raw
    counts cover every document. The threshold lies ``margin`` below the
    ``quantile`` of all trusted documents' own scores, ordered by range
    partitions.
    """
    ids = stored(trusted.select(F.col(key).alias("id")).filter("id is not null").distinct(), "trusted-ids")
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    own = texts.join(F.broadcast(ids) if ids.count() <= max_broadcast else ids, "id", "left_semi")
    own = stored(own.select("t"), "trusted-texts")

    def counted(rows: DataFrame) -> list[int]:
        each = rows.select(token_hashes(F.col("t")).alias("h")).select(F.explode(grams(F.col("h"), buckets)).alias("g"))
        out = [0] * buckets
        for r in each.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per bucket at most
            out[r["g"]] = r["n"]
        return out

    raw, target = counted(texts), counted(own)
    if not sum(target):
        return QualityModel((0,) * buckets, 0.0)
    n_raw, n_target = sum(raw) + smoothing * buckets, sum(target) + smoothing * buckets
    weights = tuple(
        round(SCALE * (math.log((a + smoothing) / n_target) - math.log((b + smoothing) / n_raw)))
        for a, b in zip(target, raw, strict=True)
    )
    own = own.select(token_hashes(F.col("t")).alias("h")).select(_score(F.col("h"), QualityModel(weights, 0.0)).alias("score"))
    low = exact_quantile(own, "score", quantile)
    return QualityModel(weights, round((low if low is not None else 0.0) - margin, 6))


def _judged(df: DataFrame, text: str, model: QualityModel, *keep: str) -> DataFrame:
    score = F.coalesce(_score(F.col("g"), model), F.lit(0.0))
    df = base_counts(df, text, list(keep), {"score": score}, token_hashes(F.col(text)))
    df = df.select(*keep, *COUNTS, base_failed().alias("base_failed"), "score")
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(model.threshold)))


def apply(docs: DataFrame, model: QualityModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, counts, ``base_failed``, ``score``, ``kept``."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return sealed(_judged(rows, "t", model, "k").withColumnRenamed("k", key))


def filter_documents(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The kept rows of ``docs`` with all their columns."""
    rows = pack(docs, "r").select("r", F.col("r")[text].alias("t"))
    judged = sealed(_judged(rows, "t", model, "r").select("r", "kept"))
    return judged.filter("kept").select("r.*")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 and toxic = 0").select("doc_id")
