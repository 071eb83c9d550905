"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the ascending array of the k smallest distinct 63-bit hashes of a
text's shingles (five lower-cased words; a shorter text is one shingle of all
its words). Sketches of parts merge into the sketch of the whole, and estimate
resemblance, containment and the number of distinct shingles.

Defined results: null and wordless texts have the empty sketch. Two empty
sketches resemble each other fully, an empty and another one not at all.
Equal texts have equal sketches. Sketches with fewer than k hashes hold the
whole set, and the estimates are then exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sealed, stored, words

K = 128
WIDTH = 5


def add_sketches(df: DataFrame, texts: dict[str, str], k: int = K, width: int = WIDTH) -> DataFrame:
    """``df`` with a sketch column for each text column: ``{text: sketch}``."""
    keep = list(df.columns)
    hashed = [F.transform(words(F.lower(F.col(t))), lambda w: F.xxhash64(w)).alias(f"__h{i}") for i, t in enumerate(texts)]
    df = df.select(*keep, *hashed)

    def sketch(h: Column) -> Column:
        n = F.size(h)
        # h is a materialised column here, so indexing it per element is cheap
        run = F.transform(
            F.slice(h, 1, F.greatest(n - (width - 1), F.lit(0))),
            lambda x, j: F.shiftrightunsigned(F.xxhash64(x, *[F.get(h, j + d) for d in range(1, width)]), 1),
        )
        short = F.array(F.shiftrightunsigned(F.xxhash64(h), 1))
        hashes = F.when(n >= width, run).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))
        return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)

    return df.select(*keep, *[sketch(F.col(f"__h{i}")).alias(name) for i, name in enumerate(texts.values())])


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(df: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """(key, sketch) of the union of every key's sketches. Hashes are made
    distinct and cut to the k smallest before the shuffle, so a key with many
    parts sends at most k hashes from a task."""
    hashes = df.select(F.col(key), F.explode(sketch).alias("h")).groupBy(key, "h").agg(F.lit(1).alias("one"))
    first = hashes.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("h"))).filter(F.col("n") <= k)
    full = first.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch))
    names = df.groupBy(key).agg(F.lit(1).alias("one"))
    return (
        names.alias("n").join(full.alias("f"), F.col(f"n.{key}").eqNullSafe(F.col(f"f.{key}")), "left")
        .select(f"n.{key}", F.coalesce(F.col(f"f.{sketch}"), F.array().cast("array<bigint>")).alias(sketch))
    )


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the Jaccard similarity of two sets."""
    u = merge(a, b, k)
    return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimate of a set's size; exact below k."""
    full = (k - 1) / (F.element_at(a, k).cast("double") / float(2**63))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(full)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of set a that is in set b; 1 if a is empty."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(both / distinct_shingles(a, k), F.lit(1.0)))


def as_text(a: Column) -> Column:
    """Sketch as a string: 16 hex digits per hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def _buckets(ids: DataFrame, parts: int) -> Column:
    """Ordered bucket of ``id`` by quantiles of all ids, looked up in two
    levels; -1 for null."""
    side = max(2, int(parts**0.5))
    cuts = ids.stat.approxQuantile("id", [i / side**2 for i in range(1, side**2)], 0.2 / side**2) if side else []
    cuts = sorted({int(c) for c in cuts})
    if not cuts:
        return F.when(F.col("id").isNull(), -1).otherwise(0)
    rows = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    count = lambda bounds: F.size(F.filter(bounds, lambda c: c <= F.col("id")))
    long = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    top = count(long([r[0] for r in rows]))
    low = count(F.get(F.array(*[long(r) for r in rows]), F.greatest(top - 1, F.lit(0))))
    return F.when(F.col("id").isNull(), -1).otherwise(top * (side + 1) + F.when(top > 0, low).otherwise(0))


def next_by_descending_id(ids: DataFrame, parts: int = 256) -> DataFrame:
    """(id, next_id) over the distinct ``id``: the next smaller one, null last,
    and after the last the first. Only ids are shuffled; each of ``parts``
    quantile buckets is ordered by itself and the bucket edges link them."""
    ids = ids.withColumn("b", _buckets(ids, parts))
    down = Window.partitionBy("b").orderBy(F.col("id").desc())
    inner = ids.withColumn("next_id", F.lead("id").over(down)).withColumn("end", F.lead(F.lit(1)).over(down).isNull())
    edges = ids.groupBy("b").agg(F.max("id").alias("first"))
    order = Window.orderBy(F.col("b").desc())  # one row per bucket
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.withColumn("last", F.lead(F.lit(1)).over(order).isNull()).withColumn(
        "after", F.when(F.lead(F.lit(1)).over(order).isNull(), F.first("first").over(whole)).otherwise(F.lead("first").over(order))
    )
    joined = inner.join(F.broadcast(edges.select("b", "after")), "b")
    return joined.select("id", F.when(F.col("end"), F.col("after")).otherwise(F.col("next_id")).alias("next_id"))


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Every text, its edited text and both sketches, with the next document's.

    Edited: the last third of the code points replaced by the first as many
    of the next document in descending id order (the last one's next is the
    first). Rows with one id are each edited; as a donor the id stands for
    its least text. The text is shuffled once by id and read from there by
    both joins; what the next document gives is at most a third as long.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    own = rows.withColumn("n", F.length("t"))
    ids = stored(own.groupBy("id").agg(F.floor(F.max("n") / 3).cast("int").alias("need"), F.count(F.lit(1)).alias("rows")), "fingerprint-ids")
    follow = next_by_descending_id(ids.select("id")).alias("f").join(ids.alias("i"), F.col("f.id").eqNullSafe(F.col("i.id"))).select("f.id", "f.next_id", "i.need")
    if ids.filter("rows > 1").limit(1).count():
        least = rows.groupBy("id").agg(F.min("t").alias("t"))
    else:
        least = rows
    donors = least.alias("d").join(follow.alias("f"), F.col("d.id").eqNullSafe(F.col("f.next_id"))).select(F.col("f.id").alias("for_id"), "need", "t")
    donors = add_sketches(donors, {"t": "next_sketch"}, k).select("for_id", F.expr("substring(t, 1, need)").alias("lead"), "next_sketch")
    both = rows.alias("r").join(donors.alias("n"), F.col("r.id").eqNullSafe(F.col("n.for_id"))).select("id", "t", "lead", "next_sketch")
    both = both.withColumn("n", F.length("t"))
    third = "cast(floor(n / 3) as int)"
    both = both.withColumn("edited", F.expr(f"concat(substring(t, 1, n - {third}), substring(lead, 1, {third}))"))
    both = add_sketches(both.select("id", "t", "n", "edited", "next_sketch"), {"t": "sketch", "edited": "edited_sketch"}, k)
    return sealed(both.select(F.col("id").alias(key), F.col("t").alias(text), F.col("n").cast("long").alias("n_chars"), "edited", "sketch", "edited_sketch", "next_sketch"))
