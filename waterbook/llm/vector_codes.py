"""Compression of vectors to codes: one codebook entry per part.

Components become whole numbers, ``floor(scale * x)``. A vector is cut into
equal parts, and every part is replaced by the index of the nearest entry of
that part's codebook (squared Euclidean distance, ties to the lower index).
Codebooks start from the vectors of the smallest ids and are refined in rounds
that replace each used entry by the floored mean of its parts.

Distances come from value dictionaries: per dimension, a batch's distinct whole
numbers get codes, one small table holds the squared difference of each of them
to every entry, and the distances of all rows are gathers from these tables by
code, added up over the part's dimensions. All sums are of whole numbers, so
neither batches nor partitions change a result.

A round is one pass in which a task adds up its parts by entry and hands on at
most ``parts * entries`` rows; only those sums and the codebooks, whose size
the parameters fix, pass through the driver.

Defined results: rows whose vector is null or holds a null or non-finite
component are left out. The length is that of the smallest id's vector; a row
of another length keeps a null code and error. When the parts do not divide
the length, they are as wide as the quotient rounded up and the last ones are
shorter. Whole numbers beyond ``LIMIT`` count as it. Of repeated ids the least
vector starts the codebook, all rows are coded; null ids are coded but start
none, and neither do start rows of another length. Fewer kept ids than entries make a smaller codebook; an empty table gives
none and no rows. Errors of equal labels are added up, null labels together,
and null when beyond 64 bits. Extra columns are ignored; very long vectors
only make batches smaller.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Whole numbers of greater magnitude count as this, so that sums fit 64 bits.
LIMIT = 1 << 27

#: Numbers in a gathered block of rows by entries.
GATHER = 1 << 20


@dataclass(frozen=True)
class Codebooks:
    """Entries of every part: an array (entries, width of the part) each."""

    length: int
    entries: tuple[np.ndarray, ...]

    @property
    def digest(self) -> str:
        numbers = [str(v) for part in self.entries for v in part.ravel().tolist()]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def part_bounds(length: int, parts: int) -> list[tuple[int, int]]:
    width = -(-length // parts)
    return [(min(p * width, length), min((p + 1) * width, length)) for p in range(parts)]


def kept_vectors(vectors: DataFrame, keep: list[str], vector: str, scale: int) -> DataFrame:
    """``keep`` columns and the whole numbers ``v`` of every fit row."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fit = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    whole = lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT))))
    rows = vectors.filter(F.coalesce(fit, F.lit(False)))
    return rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.transform(v, whole).cast("array<int>").alias("v"))


def _start_batches(entries: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[int]] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            least = np.unique(ids)[:entries]
            for row in np.flatnonzero(np.isin(ids, least)):
                i, v = int(ids[row]), batch.column(1)[int(row)].as_py()
                held[i] = min(held.get(i, v), v)
            held = {i: held[i] for i in sorted(held)[:entries]}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.list_(pa.int32()))], ["c0", "v"])

    return run


def _matrix(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the right length as a matrix, and where they lie."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == length)
    flat = (column if len(rows) == len(size) else column.take(pa.array(rows))).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(rows), max(length, 0)), rows


class Distances:
    """Nearest entries of the parts of whole-number rows, by value dictionaries."""

    def __init__(self, books: Codebooks):
        self.books = books
        self.bounds = np.cumsum([0, *(e.shape[1] for e in books.entries)]).tolist()

    def nearest(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) indexes and squared distances."""
        n, parts = len(values), len(self.books.entries)
        index, error = np.zeros((n, parts), dtype=np.int64), np.zeros((n, parts), dtype=np.int64)
        for p, entries in enumerate(self.books.entries):
            codes, tables, most = [], [], 0
            for d in range(entries.shape[1]):
                code, distinct = pd.factorize(values[:, self.bounds[p] + d])
                table = (distinct.astype(np.int64)[:, None] - entries[None, :, d]) ** 2
                codes.append(code)
                tables.append(table)
                most += int(table.max(initial=0))
            if most < 1 << 31:  # the same sums in half the room
                tables = [t.astype(np.int32) for t in tables]
            step = max(1, GATHER // max(1, len(entries)))
            for at in range(0, n, step):
                end = min(at + step, n)
                total = np.zeros((end - at, len(entries)), dtype=tables[0].dtype if tables else np.int64)
                for code, table in zip(codes, tables, strict=True):
                    total += table[code[at:end]]
                index[at:end, p] = best = total.argmin(axis=1)  # the first of equal ones
                error[at:end, p] = total[np.arange(end - at), best]
        return index, error


def _sum_batches(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Distances(books)
        sums = [np.zeros(e.shape, dtype=np.int64) for e in books.entries]
        counts = [np.zeros(len(e), dtype=np.int64) for e in books.entries]
        for batch in batches:
            values, _ = _matrix(batch.column(0), books.length)
            index, _ = find.nearest(values)
            for p, e in enumerate(books.entries):
                counts[p] += np.bincount(index[:, p], minlength=len(e))
                for d in range(e.shape[1]):  # bincount adds doubles: in halves, each exact
                    x = values[:, find.bounds[p] + d].astype(np.int64)
                    low, high = x & 0x3FFF, x >> 14
                    added = [np.bincount(index[:, p], weights=w, minlength=len(e)).astype(np.int64) for w in (low, high)]
                    sums[p][:, d] += added[0] + (added[1] << 14)
        used = [(p, k) for p, c in enumerate(counts) for k in np.flatnonzero(c).tolist()]
        if used:
            columns = [pa.array([x[0] for x in used], pa.int32()), pa.array([x[1] for x in used], pa.int32())]
            columns += [pa.array([int(counts[p][k]) for p, k in used], pa.int64()), pa.array([sums[p][k].tolist() for p, k in used], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    return run


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks:
    """Codebooks of all fit rows. The starting vectors are the smallest ids:
    every task names its smallest, and the least of those are taken."""
    rows = kept_vectors(vectors, [key], vector, scale)
    own = rows.filter("c0 is not null").select(F.col("c0").cast("bigint"), "v").mapInArrow(_start_batches(entries), "c0 bigint, v array<int>")
    start = own.groupBy("c0").agg(F.min("v").alias("v")).orderBy("c0").limit(entries).collect()
    if not start:
        return Codebooks(-1, ())
    length = len(start[0]["v"])
    first = np.array([r["v"] for r in start if len(r["v"]) == length], dtype=np.int64).reshape(-1, length)
    books = Codebooks(length, tuple(first[:, a:b] for a, b in part_bounds(length, parts)))
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(_sum_batches(books), "part int, entry int, n bigint, sums array<bigint>")
        each = sums.select("part", "entry", "n", F.posexplode_outer("sums").alias("d", "s"))
        total = each.groupBy("part", "entry", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # parts * entries * width at most
        new = [e.copy() for e in books.entries]
        for r in total:
            if r["d"] is not None:
                new[r["part"]][r["entry"], r["d"]] = r["s"] // r["n"]
        books = Codebooks(length, tuple(new))
    return books


def _code_batches(books: Codebooks, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Distances(books)
        digits = 2 * max(1, -(-(max((len(e) - 1).bit_length() for e in books.entries)) // 8)) if books.entries else 2
        texts = np.array([f"{k:0{digits}x}" for k in range(max((len(e) for e in books.entries), default=0))], dtype=f"U{digits}")
        for batch in batches:
            values, rows = _matrix(batch.column(len(names)), books.length)
            index, error = find.nearest(values)
            flat = np.ascontiguousarray(texts[index]).view(f"U{digits * index.shape[1]}").ravel() if len(index) else np.empty(0, dtype="U2")
            code, total = np.full(batch.num_rows, None, dtype=object), np.full(batch.num_rows, -1, dtype=np.int64)
            code[rows], total[rows] = flat, error.sum(axis=1)
            columns = [*(batch.column(i) for i in range(len(names))), pa.array(code, pa.string()), pa.array(total, mask=total < 0)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "code", "error"])

    return run


def encode(vectors: DataFrame, books: Codebooks, keep: list[str], vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``keep`` columns, ``code`` (two hex digits a part, in part order) and
    ``error``, the squared distance to the coded vector."""
    if {"code", "error"} & set(keep):
        raise ValueError("kept columns are called neither code nor error")
    rows = kept_vectors(vectors, keep, vector, scale)
    names = [f"c{i}" for i in range(len(keep))]
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    coded = rows.mapInArrow(_code_batches(books, names), f"{kinds}, code string, error bigint")
    return coded.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "code", "error")


def decode(coded: DataFrame, books: Codebooks, code: str = "code", into: str = "vector", scale: int = 256) -> DataFrame:
    """``coded`` with the vector that each code stands for (entries over
    ``scale``); null where the code is null. Codes of two digits a part."""
    tables = [F.array(*[F.array(*[F.lit(v / scale) for v in row]) for row in e.tolist()]) for e in books.entries]
    at = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return coded.withColumn(into, F.when(F.col(code).isNotNull(), F.concat(*[F.get(t, at(p)) for p, t in enumerate(tables)])))


def with_label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded``, stored, with ``label_error``: the error of all rows of its
    label. Sums are added up before the shuffle and stored, so their size is
    known when Spark chooses the join."""
    rows = stored(coded, "vector-codes")
    sums = rows.groupBy(F.col(label).alias("of")).agg(F.try_sum("error").alias("label_error"))
    sums = stored(sums, "label-errors")
    return rows.join(sums, rows[label].eqNullSafe(sums["of"]), "left").drop("of")
