"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1, linear between its
knots. The integral of the schedule is the source's weight; the weights share
the token budget, a source being read at most ``max_epochs`` times, with what
it cannot give reshared by weight. A source's demand up to time t is its
target times the integral of its schedule up to t; inverting that function
gives every copy of a document the time at which the middle of its words is
due, and sorting by that time (a range partitioning) is the training order.

Inside a source documents follow a seeded hash order. Offsets in that order
are sums over hash buckets plus a running sum inside a bucket, so a source
with a third of all rows is spread over ``buckets`` tasks.

Defined results: null texts and texts without words have size 0 and no copy;
null sources form one source, ordered last; repeated rows are separate rows;
equal rows share their places in either order. An empty table gives no rows.
A target that ends inside a document takes only its leading words there
(``training_sequence(whole=True)`` rounds to whole documents). The table of
sources, one row each, passes through one task: sources are the configured
parts of a mixture, not something that grows with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pack, sealed, stored, words

#: Knots (time, factor) of the default curriculum, by the place of a source's
#: weight in the cycle: constant, rising, falling. Each integrates to 1.
CURRICULUM = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))

SEGMENT = "struct<t0:double,t1:double,w0:double,w1:double,f0:double,f1:double>"


def segments(knots: Sequence[tuple[float, float]]) -> tuple[float, list[tuple[float, ...]]]:
    """The integral of a schedule, and its linear pieces with the fraction of
    the integral at both ends."""
    if len(knots) < 2 or knots[0][0] != 0.0 or knots[-1][0] != 1.0 or any(w < 0 for _, w in knots):
        raise ValueError("a schedule needs knots from time 0 to 1 and no negative weight")
    pieces = [(a, b, v, w, (b - a) * (v + w) / 2) for (a, v), (b, w) in zip(knots, knots[1:], strict=False)]
    if any(p[1] < p[0] for p in pieces):
        raise ValueError("knots must be in order of time")
    total = sum(p[4] for p in pieces)
    if total <= 0:
        raise ValueError("a schedule must have weight")
    out, done = [], 0.0
    for a, b, v, w, area in pieces:
        if area > 0:
            out.append((a, b, v, w, done / total, (done + area) / total))
            done += area
    return total, out


def invert(demand: Column, pieces: Column) -> Column:
    """Time at which the integral of the pieces reaches the fraction ``demand``."""
    p = F.coalesce(F.get(F.filter(pieces, lambda s: demand < s["f1"]), F.lit(0)), F.element_at(pieces, -1))
    # area from the start of the piece: w0 x + (w1 - w0) / (2 h) x^2
    whole = (p["w0"] + p["w1"]) / 2 * (p["t1"] - p["t0"])
    area = F.greatest(demand - p["f0"], F.lit(0.0)) / (p["f1"] - p["f0"]) * whole
    slope = (p["w1"] - p["w0"]) / (p["t1"] - p["t0"])
    root = F.sqrt(F.greatest(p["w0"] * p["w0"] + 2 * slope * area, F.lit(0.0)))
    x = F.when(area > 0, 2 * area / (p["w0"] + root)).otherwise(F.lit(0.0))
    return F.least(p["t0"] + x, p["t1"])


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), curriculum: Sequence = CURRICULUM, max_epochs: float = 3, share: float = 1.0
) -> DataFrame:
    """From (source, source_size): also ``target`` and ``pieces``.

    Sources in code point order, null last, take ``weights`` (and the
    schedules of ``curriculum``, whose integrals scale them) in a cycle. The
    water level: sources sorted by the level at which they are full; the
    first that is not full at the level of the rest sets it.
    """
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cut = [segments(curriculum[i % len(curriculum)]) for i in range(len(weights))]
    w = F.array(*[F.lit(float(x) * c[0]) for x, c in zip(weights, cut, strict=True)])
    shapes = F.array(*[F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("t0", "t1", "w0", "w1", "f0", "f1"), s, strict=True)]) for s in c[1]]) for c in cut])
    df = sizes.withColumn("i", F.pmod(rank, F.lit(len(weights)))).withColumn("w", F.get(w, F.col("i"))).withColumn("pieces", F.get(shapes, F.col("i")))
    df = df.withColumn("most", F.lit(float(max_epochs)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    df = df.withColumn("level", left / weight).withColumn("n", F.row_number().over(by_level))
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), F.struct("n", "level"))).over(every)["level"]
    target = F.least(F.col("most"), F.coalesce(first * F.col("w"), F.col("most")))
    return df.withColumn("target", target).select("source", "source_size", "target", "pieces")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    curriculum: Sequence = CURRICULUM,
    max_epochs: float = 3,
    share: float = 1.0,
    seed: int = 17,
    buckets: int = 1024,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Per row of ``docs``: struct ``row`` (its columns, or only ``carry``), ``size``,
    ``source_size``, ``target``, ``taken`` and ``copies``, an array of
    (epoch, words, position)."""
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    t = F.col("all")[text]
    h = F.xxhash64(F.lit(seed), F.col("all")[key], t)
    row = F.col("all") if carry is None else F.struct(*[F.col("all")[c].alias(c) for c in carry])
    rows = pack(docs, "all").select(row.alias("row"), F.col("all")[source].alias("source"), F.size(words(t)).cast("long").alias("size"), h.alias("h"))
    rows = rows.withColumn("b", F.shiftrightunsigned("h", 64 - buckets.bit_length() + 1).cast("int") if buckets > 1 else F.lit(0))

    parts = stored(rows.groupBy("source", "b").agg(F.sum("size").alias("part")), "mix-parts")
    sources = source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), weights, curriculum, max_epochs, share)
    earlier = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("base", F.coalesce(F.sum("part").over(earlier), F.lit(0))).drop("part")
    offsets = offsets.alias("o").join(sources.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source"))).select("o.source", "b", "base", "source_size", "target", "pieces")
    offsets = stored(offsets, "mix-offsets")

    inside = Window.partitionBy("source", "b").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.alias("r").join(offsets.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.b") == F.col("o.b")))
    rows = rows.select("row", "size", "source_size", "target", "pieces", (F.col("base") + F.col("inside")).alias("offset"), F.round("target").cast("long").alias("goal"))

    def copy(e: Column) -> Column:
        start = e.cast("long") * F.col("source_size") + F.col("offset")
        took = F.greatest(F.least(F.col("goal") - start, F.col("size")), F.lit(0).cast("long"))
        middle = (start + took / 2) / F.greatest(F.col("goal"), F.lit(1))
        return F.struct(e.cast("int").alias("epoch"), took.alias("words"), invert(middle, F.col("pieces")).alias("position"))

    copies = F.transform(F.sequence(F.lit(0), F.lit(int(-(-max_epochs // 1)) - 1)), copy)
    rows = rows.withColumn("copies", F.filter(copies, lambda c: c["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda acc, c: acc + c["words"])
    return sealed(rows.select("row", "size", "source_size", "target", taken.alias("taken"), "copies"))


def training_sequence(mixed: DataFrame, whole: bool = False) -> DataFrame:
    """One row per copy in training order: ``row``, ``size`` and the copy's
    epoch, words and position. ``whole``: a copy of which less than half is
    due goes, any other is taken in full."""
    out = mixed.select("row", "size", F.explode("copies").alias("c")).select("row", "size", "c.*")
    if whole:
        out = out.filter(2 * F.col("words") >= F.col("size")).withColumn("words", F.col("size"))
    return out.orderBy("position", "epoch")
