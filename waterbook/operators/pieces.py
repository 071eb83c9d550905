"""Cut long overlap components where the lowest id decides.

In the refuse rule an order is kept if it overlaps no kept earlier one. The
lowest id of a component therefore is always kept, and every order that
overlaps it is refused. What remains lies before or after it, and no order of
one side overlaps one of the other: the sides are components of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waterbook.operators.replay import COMPONENT_KEY
from waterbook.session import ensure_checkpoint_dir, shared_folder

STALLED_AFTER = 3  # rounds in which the longest piece may stay above nine tenths


def _written(df: DataFrame, label: str) -> DataFrame:
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_long(rows: DataFrame, max_piece: int = 20_000, rounds: int = 24) -> tuple[DataFrame, DataFrame]:
    """``(open, refused)`` of rows ``(id, car, start_at, end_at,
    component_lo, component_id)`` with unique ids and no null time.

    ``refused`` has the ids that are certainly refused, ``open`` the rows
    still to be decided, with the piece in place of the component; orders that
    are certainly kept are in neither. Only components of more than
    ``max_piece`` rows are cut; their counts and lowest ids are one aggregate a
    round, combined before its shuffle, and only rows of such components are
    written again. Orders entered in any mixed order halve a component in each
    round. Orders entered in the order of their times take one order off it;
    when the longest piece stays above nine tenths for three rounds, or after
    ``rounds``, what is left remains whole. The decisions are the same however
    far the cutting goes.

    A lowest order that ends before it starts has no clean sides; it decides
    its overlaps and the component stays in one piece. Two pieces may get the
    same name when an order lasts no time; they are then one piece, which
    changes no decision. An empty table gives two empty results.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    now = _written(rows, "orders")
    columns, settled, refused, longest = now.columns, [], [], []
    for _ in range(rounds):
        first = F.min(F.struct("id", F.col("start_at").alias("s"), F.col("end_at").alias("e"))).alias("first")
        pieces = now.groupBy(*COMPONENT_KEY).agg(F.count(F.lit(1)).alias("n"), first)
        pieces = _written(pieces.where(F.col("n") > max_piece), "long-pieces")
        top = pieces.agg(F.max("n")).first()[0]
        if top is None:
            break
        longest.append(top)
        if len(longest) > STALLED_AFTER and top > 0.9 * longest[-1 - STALLED_AFTER]:
            break
        settled.append(now.join(pieces, COMPONENT_KEY, "left_anti").select(*columns))
        meets = (F.col("start_at") < F.col("first.e")) & (F.col("end_at") > F.col("first.s"))
        after = (F.col("first.s") <= F.col("first.e")) & (F.col("start_at") >= F.col("first.e"))
        fate = F.when(F.col("id") == F.col("first.id"), "kept").when(meets, "refused").otherwise("open")
        cut = now.join(pieces, COMPONENT_KEY).select(
            "id",
            "car",
            "start_at",
            "end_at",
            F.when(after, F.col("first.e")).otherwise(F.col("component_lo")).alias("component_lo"),
            F.when(after, F.col("first.id")).otherwise(F.col("component_id")).alias("component_id"),
            fate.alias("fate"),
        )
        cut = _written(cut, "cut-orders")
        refused.append(cut.where(F.col("fate") == "refused").select("id"))
        now = cut.where(F.col("fate") == "open").select(*columns)
    left = now.select(*columns)
    for part in settled:
        left = left.union(part)
    out = now.where(F.lit(False)).select("id")
    for part in refused:
        out = out.union(part)
    return left, out
