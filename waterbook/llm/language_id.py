"""Language identification by character language models.

One interpolated Kneser-Ney model of order 4 per language, over lower-cased
letters with any run of other characters as one blank. Counting runs on Spark
over every training document, and every n-gram counts: totals, continuation
counts and discounts are Spark aggregates. The driver holds a few numbers per
language; n-grams and contexts of all languages lie in the shared folder, in
parts by the leading bits of a 64-bit hash, sorted by it, where scoring tasks
look them up. A task keeps up to ``CACHED`` rows of them and reads the other
parts again for every piece of text.

The prediction is the language of the lowest cross-entropy per symbol. It is
accepted unless that entropy is further above the language's usual one than
nearly all texts learned from are, each scored with itself and its copies left
out of the counts. So counts cover every text, and every text calibrates.

Defined results: a null text, one without a letter, or any text when there was
nothing to learn from, gives ``und``, score 0, not accepted. Ties go to the
language that sorts first. Rows are judged one by one, so repeated rows agree
and null ids are no special case; rows with a null text or language are not
learned from.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import exact_quantile, shared_path, stored
from .warc import file_system

ORDER = 4
EDGE, BLANK = 1, 32
#: Characters handled at once inside a task.
PIECE = 400_000
#: Rows of a stored model: about as many in a part, at most as many kept by a task.
PART, CACHED = 500_000, 6_000_000
LEAST_PARTS = 32
#: Texts with copies whose counts are broadcast.
COPIED = 2_000_000
UNKNOWN = "und"
#: Calibration by every text left out of the counts, as the query and the pipeline do it.
CALIBRATION = {"leave_out": True, "slack": 2.0}


def letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def symbols(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, each after ORDER - 1 edge symbols, and
    the index of the text of every symbol."""
    edge = chr(EDGE) * (ORDER - 1)
    joined = "".join(edge + (t.replace(chr(EDGE), " ") if chr(EDGE) in t else t).lower() for t in texts)
    s = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    s = np.where(letters[s] | (s == EDGE), s, np.uint32(BLANK))
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != BLANK) | ((s[:-1] != BLANK) & (s[:-1] != EDGE))
    s = s[keep]
    # an empty text leaves two edges in a row: count edges instead of their starts
    owner = (np.cumsum(s == EDGE, dtype=np.int64) - 1) // (ORDER - 1)
    return s.astype(np.uint64), owner


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of n-grams given as one array per place."""
    h = np.full(len(columns[0]), len(columns) * 0x2545F491, dtype=np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
    return mix(h)


class SortedTable:
    """Rows found by a sorted array of hashes; an index of where each run of
    leading bits starts makes a lookup a few probes."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], np.ascontiguousarray(rows[order])
        self.bits = max(1, int(len(keys)).bit_length())
        self.start = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row number of every hash, -1 where there is none."""
        n = len(self.keys)
        out = np.full(len(h), -1, dtype=np.int64)
        if not n:
            return out
        at = self.start[h >> np.uint64(64 - self.bits)]
        todo = np.arange(len(h))
        while len(todo):
            inside = at < n
            got = self.keys[np.minimum(at, n - 1)]
            hit = inside & (got == h)
            out[todo[hit]] = at[hit]
            go = inside & (got < h)
            todo, at, h = todo[go], at[go] + 1, h[go]
        return out


@dataclass
class LanguageModel:
    """``tables[m - 1]``: log probabilities of m-grams; ``backoff[m - 1]``: log
    weights that a context of m symbols leaves to the lower order."""

    languages: list[str]
    tables: list[SortedTable] = field(default_factory=list)
    backoff: list[SortedTable] = field(default_factory=list)
    unseen: float = 0.0
    usual: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: float = float("inf")
    allowed: float = 0.0

    def log_probabilities(self, columns: list[np.ndarray]) -> np.ndarray:
        m = len(columns)
        if not m:
            return np.empty((0, len(self.languages)), dtype=np.float32)
        row = self.tables[m - 1].find(gram_hash(columns))
        out = self.tables[m - 1].rows[np.maximum(row, 0)]
        miss = np.flatnonzero(row < 0)
        if len(miss):
            rest = [c[miss] for c in columns]
            if m == 1:
                out[miss] = self.unseen
            else:
                lower = self.log_probabilities(rest[1:])
                context = self.backoff[m - 2].find(gram_hash(rest[:-1]))
                known = context >= 0
                lower[known] += self.backoff[m - 2].rows[context[known]]
                out[miss] = lower
        return out

    def entropies(self, texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: symbols, cross-entropy per symbol by language, and
        whether it has a letter."""
        s, owner = symbols(texts, letters)
        inner = np.flatnonzero(s != EDGE)
        whose = owner[inner]
        lp = self.log_probabilities([s[inner - d] for d in range(ORDER - 1, -1, -1)])
        return self.per_text(lp, whose, s[inner], len(texts))

    @staticmethod
    def per_text(lp: np.ndarray, whose: np.ndarray, s: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.bincount(whose, minlength=texts)
        sums = np.stack([np.bincount(whose, weights=lp[:, i], minlength=texts) for i in range(lp.shape[1])], axis=1)
        lettered = np.bincount(whose, weights=s != BLANK, minlength=texts) > 0
        return n, -sums / np.maximum(n, 1)[:, None], lettered


def context_hash(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of contexts, other than that of an n-gram of the same symbols."""
    return gram_hash([*columns, np.full(len(columns[0]), 1 << 21, dtype=np.uint64)])


def read_part(folder: str, part: int) -> tuple[np.ndarray, ...]:
    """Sorted hashes, where the rows of each start, and the rows: language,
    count, kinds."""
    from pyarrow import fs as pafs

    fs, root = file_system(f"{folder}/part={part}")
    files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".parquet"))
    got = [pq.ParquetFile(fs.open_input_file(f)).read(["key", "lang", "count", "kinds"]) for f in files]
    if not got:
        return np.empty(0, dtype=np.uint64), np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int32), np.empty(0), np.empty(0)
    rows = pa.concat_tables(got)
    key, lang, count, kinds = (rows[c].to_numpy() for c in rows.column_names)
    order = np.argsort(key.view(np.uint64), kind="stable")
    keys, start = np.unique(key.view(np.uint64)[order], return_index=True)
    return keys, np.append(start, len(key)), lang[order], count[order], kinds[order]


@dataclass
class StoredModel(LanguageModel):
    """A model whose n-grams lie in ``folder``. By order and language:
    ``discount``; by language: ``total`` and ``kinds`` of the unigrams."""

    folder: str = ""
    bits: int = 0
    alphabet: int = 1
    discount: np.ndarray | None = None
    total: np.ndarray | None = None
    kinds: np.ndarray | None = None
    held: dict[int, tuple[np.ndarray, ...]] = field(default_factory=dict)
    room: int = CACHED

    def part(self, number: int) -> tuple[np.ndarray, ...]:
        got = self.held.get(number)
        if got is None:
            got = read_part(self.folder, number)
            if len(got[2]) <= self.room:
                self.held[number], self.room = got, self.room - len(got[2])
        return got

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count and kinds by language of every hash, and whether it is there."""
        count, kinds = np.zeros((2, len(h), len(self.languages)))
        there = np.zeros(len(h), dtype=bool)
        order = np.argsort(h)
        h = h[order]
        parts, at = np.unique(h >> np.uint64(64 - self.bits), return_index=True)
        for number, first, end in zip(parts.tolist(), at, [*at[1:], len(h)], strict=True):
            keys, start, lang, n, k = self.part(number)
            if not len(keys):
                continue
            row = np.minimum(np.searchsorted(keys, h[first:end]), len(keys) - 1)
            hit = np.flatnonzero(keys[row] == h[first:end])
            row, to = row[hit], order[first + hit]
            size = start[row + 1] - start[row]
            run = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[row], size)
            count[np.repeat(to, size), lang[run]] = n[run]
            kinds[np.repeat(to, size), lang[run]] = k[run]
            there[to] = True
        return count, kinds, there

    def found(self, columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, tuple[np.ndarray, ...]]:
        """The distinct n-grams, which of them stands at every place, and what
        ``look_up`` finds: their m-grams by rising order, then their contexts."""
        _, first, back = np.unique(gram_hash(columns), return_index=True, return_inverse=True)
        c = [x[first] for x in columns]
        asked = [gram_hash(c[-m:]) for m in range(1, ORDER + 1)] + [context_hash(c[-m:-1]) for m in range(2, ORDER + 1)]
        return c, back.ravel(), self.look_up(np.concatenate(asked))

    def log_of(self, size: int, found: tuple[np.ndarray, ...]) -> np.ndarray:
        count, kinds, there = found
        p = np.full((size, len(self.languages)), 1 / self.alphabet)
        for m in range(1, ORDER + 1):
            gram, context = self.places(size, m)
            total, follow = (self.total, self.kinds) if m == 1 else (count[context], kinds[context])
            discount = self.discount[m - 1]
            known = (there[gram, None] if m == 1 else True) & (total > 0)
            p = np.where(known, (np.maximum(count[gram] - discount, 0) + discount * follow * p) / np.maximum(total, 1e-300), p)
        return np.log(p).astype(np.float32)

    @staticmethod
    def places(size: int, m: int) -> tuple[slice, slice]:
        return slice((m - 1) * size, m * size), slice((ORDER + m - 2) * size, (ORDER + m - 1) * size)

    def log_probabilities(self, columns: list[np.ndarray]) -> np.ndarray:
        if not len(columns[0]):
            return np.empty((0, len(self.languages)), dtype=np.float32)
        c, back, found = self.found(columns)
        return self.log_of(len(c[0]), found)[back]

    def left_out(self, texts: list[str], letters: np.ndarray, own: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, ...]:
        """``entropies``, and per text its cross-entropy by the language
        numbered ``own`` (-1: none, NaN) as if the text, which occurs
        ``copies`` times there, had not been counted; discounts stay."""
        s, owner = symbols(texts, letters)
        inner = np.flatnonzero(s != EDGE)
        if not len(inner):
            return *self.per_text(np.empty((0, len(self.languages))), owner[inner], s[inner], len(texts)), np.full(len(texts), np.nan)
        c, back, found = self.found([s[inner - d] for d in range(ORDER - 1, -1, -1)])
        whose, size = owner[inner], len(c[0])
        n, h, lettered = self.per_text(self.log_of(size, found)[back], whose, s[inner], len(texts))
        mine = own[whose] >= 0
        pair, times = np.unique(whose[mine] * size + back[mine], return_counts=True)
        who, gram = pair // max(size, 1), pair % max(size, 1)
        if not len(pair):
            return n, h, lettered, np.full(len(texts), np.nan)
        count, kinds, _ = found
        lang = own[who]

        def each(hashes: np.ndarray | None, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """First row of every (text, hash), and which of them every row is."""
            names = np.zeros(len(rows), dtype=np.int64) if hashes is None else np.unique(hashes, return_inverse=True)[1].ravel()[gram[rows]]
            _, first, which = np.unique(who[rows] * (size + 1) + names, return_index=True, return_inverse=True)
            return rows[first], which.ravel()

        # from the highest order down: rows stand for the text's own m-grams,
        # of which ``less`` is taken away; a type that none is left of no longer
        # counts below. ``at`` tells the m-gram of every (text, n-gram)
        rows, at = np.arange(len(pair)), np.arange(len(pair))
        less = times * copies[who]
        parts = []
        for m in range(ORDER, 0, -1):
            place, context = self.places(size, m)
            had = count[place][gram[rows], lang[rows]]
            gone = (had > 0) & (had <= less)
            head, which = each(context_hash(c[-m:-1]) if m > 1 else None, rows)
            fewer, lost = np.bincount(which, weights=less), np.bincount(which, weights=gone)
            total, follow = (count[context][gram[rows], lang[rows]], kinds[context][gram[rows], lang[rows]]) if m > 1 else (self.total[lang[rows]], self.kinds[lang[rows]])
            total, follow = total - fewer[which], follow - lost[which]
            there = total > 0
            if m == 1:
                there &= count[place][gram[rows]].sum(axis=1) > less
            parts.append((np.maximum(had - less, 0)[at], total[at], follow[at], there[at], self.discount[m - 1][lang]))
            if m > 1:
                rows, which = each(gram_hash(c[-m + 1 :]), rows)
                less, at = np.bincount(which, weights=gone), which[at]
        p = np.full(len(pair), 1 / self.alphabet)
        for had, total, follow, there, discount in reversed(parts):
            p = np.where(there, (np.maximum(had - discount, 0) + discount * follow * p) / np.maximum(total, 1e-300), p)
        bits = np.bincount(who, weights=-np.log(p) * times, minlength=len(texts))
        return n, h, lettered, np.where((own >= 0) & (n > 0), bits / np.maximum(n, 1), np.nan)


def pieces(texts: list[str], most: int = PIECE) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size < most or end == at):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, context, symbol) of a task, combined in bounded tables."""
    letters = letter_table()
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def combine() -> tuple[np.ndarray, ...]:
        k, lang, ctx, sym, n = (np.concatenate(x) for x in zip(*held, strict=True))
        _, at, back = np.unique(k, return_index=True, return_inverse=True)
        return k[at], lang[at], ctx[at], sym[at], np.bincount(back, weights=n).astype(np.int64)

    def out(table: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        _, lang, ctx, sym, n = table
        codes = pa.DictionaryArray.from_arrays(pa.array(lang.astype(np.int32)), pa.array(list(names), pa.string()))
        return pa.RecordBatch.from_arrays([codes.cast(pa.string()), pa.array(ctx.astype(np.int64)), pa.array(sym.astype(np.int32)), pa.array(n)], ["lang", "ctx", "sym", "n"])

    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at, end in pieces(texts):
            ids = np.array([names.setdefault(x, len(names)) for x in langs[at:end]], dtype=np.uint64)
            s, owner = symbols(texts[at:end], letters)
            inner = np.flatnonzero(s != EDGE)
            if not len(inner):
                continue
            lang = ids[owner[inner]]
            c = [s[inner - d] for d in range(ORDER - 1, -1, -1)]
            k = gram_hash([*c, lang])
            k, first, n = np.unique(k, return_index=True, return_counts=True)
            ctx = (c[0][first] << np.uint64(42)) | (c[1][first] << np.uint64(21)) | c[2][first]
            held.append((k, lang[first], ctx, c[3][first], n))
            rows += len(k)
            if rows > 1_000_000:
                held = [combine()]
                rows = len(held[0][0])
                if rows > 500_000:
                    yield out(held[0])
                    held, rows = [], 0
    if held:
        yield out(combine())


def count_ngrams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, ctx, sym, n) over all rows; ctx packs three 21-bit symbols."""
    rows = docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).filter("t is not null and l is not null")
    counts = rows.mapInArrow(_count_batches, "lang string, ctx bigint, sym int, n bigint")
    return counts.groupBy("lang", "ctx", "sym").agg(F.sum("n").alias("n"))


def kneser_ney(counts: pd.DataFrame) -> LanguageModel:
    """The model of n-gram counts (lang, ctx, sym, n) in memory, which
    ``store_model`` must equal."""
    languages = sorted(counts["lang"].unique())
    model = LanguageModel(languages)
    if not languages:
        return model
    size = len(languages)
    lang = counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    ctx = counts["ctx"].to_numpy().astype(np.uint64)
    mask = np.uint64((1 << 21) - 1)
    grams = np.stack([ctx >> np.uint64(42), (ctx >> np.uint64(21)) & mask, ctx & mask, counts["sym"].to_numpy().astype(np.uint64)], axis=1)
    value = counts["n"].to_numpy().astype(float)
    levels = []  # from the highest order down: n-grams of any language, count by language
    for m in range(ORDER, 0, -1):
        uniq, back = np.unique(grams, axis=0, return_inverse=True)
        table = np.zeros((len(uniq), size))
        np.add.at(table, (back.ravel(), lang), value)
        levels.append((uniq, table))
        # types with one symbol less: how many different symbols they follow
        rows, lang = np.nonzero(table)
        grams, value = uniq[rows][:, 1:], np.ones(len(rows))
    alphabet = len(levels[-1][0]) + 1
    model.unseen = float(-np.log(alphabet))
    below = np.full((1, size), 1 / alphabet)
    for m, (uniq, table) in enumerate(reversed(levels), 1):
        one, two = (table == 1).sum(axis=0), (table == 2).sum(axis=0)
        discount = np.where(one + 2 * two > 0, one / np.maximum(one + 2 * two, 1), 0.5).clip(0.1, 0.9)
        contexts, which = np.unique(uniq[:, :-1], axis=0, return_inverse=True)
        which = which.ravel()
        total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
        np.add.at(total, which, table)
        np.add.at(kinds, which, table > 0)
        left = np.where(total > 0, discount * kinds / np.maximum(total, 1e-300), 1.0)
        if m == 1:
            lower = below
        else:  # the suffix of every n-gram is among the lower n-grams
            at = model.tables[-1].find(gram_hash([uniq[:, i] for i in range(1, m)]))
            lower = np.exp(model.tables[-1].rows[at].astype(float))
        own = np.where(total[which] > 0, np.maximum(table - discount, 0) / np.maximum(total[which], 1e-300), 0.0)
        p = own + left[which] * lower
        model.tables.append(SortedTable(gram_hash([uniq[:, i] for i in range(m)]), np.log(p).astype(np.float32)))
        if m > 1:
            model.backoff.append(SortedTable(gram_hash([contexts[:, i] for i in range(m - 1)]), np.log(left).astype(np.float32)))
    return model


def _key_batches(languages: list[str], bits: int):
    """(part, key, lang, count, kinds) of rows (m, context, lang, ctx, sym, count, kinds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64((1 << 21) - 1)
        at = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            m, context, sym = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 4))
            ctx = batch.column(3).to_numpy().astype(np.uint64)
            lang = np.array([at[x] for x in batch.column(2).to_pylist()], dtype=np.int32)
            back = [(ctx >> np.uint64(21 * d)) & mask for d in range(ORDER - 1)]  # from the last symbol of the context
            key = np.zeros(len(m), dtype=np.uint64)
            for order in range(1, ORDER + 1):
                own = [back[d] for d in range(order - 2, -1, -1)]
                for is_context in (False, True) if order > 1 else (False,):
                    rows = np.flatnonzero((m == order) & (context == is_context))
                    before = [c[rows] for c in own]
                    key[rows] = context_hash(before) if is_context else gram_hash([*before, sym[rows].astype(np.uint64)])
            part = (key >> np.uint64(64 - bits)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(key.view(np.int64)), pa.array(lang), batch.column(5), batch.column(6)], ["part", "key", "lang", "count", "kinds"])

    return run


def store_model(counts: DataFrame) -> StoredModel:
    """The model of all n-gram counts (lang, ctx, sym, n), kept in the shared folder."""
    spark = counts.sparkSession
    levels = [stored(counts, "ngrams-4")]
    for m in range(ORDER - 1, 0, -1):  # types of one symbol more: how many different symbols they follow
        ctx = F.col("ctx").bitwiseAND(F.lit((1 << 21 * (m - 1)) - 1).cast("long"))
        lower = levels[0].groupBy("lang", ctx.alias("ctx"), "sym").agg(F.count(F.lit(1)).alias("n"))
        levels.insert(0, stored(lower, f"ngrams-{m}"))
    union = lambda a, b: a.unionByName(b)
    facts = [F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two")]
    known = reduce(union, (df.groupBy("lang").agg(*facts).withColumn("m", F.lit(m)) for m, df in enumerate(levels, 1))).toPandas()  # a row per order and language
    languages = sorted(known["lang"].unique())
    if not languages:
        return StoredModel(languages)
    of = {m: own.set_index("lang").loc[languages] for m, own in known.groupby("m")}
    one, two = (np.array([of[m][c].to_numpy() for m in range(1, ORDER + 1)]) for c in ("one", "two"))
    bits = (max(LEAST_PARTS, -(-2 * int(known["kinds"].sum()) // PART)) - 1).bit_length()
    model = StoredModel(
        languages, folder=shared_path(spark, "language-model"), bits=bits, alphabet=levels[0].select("sym").distinct().count() + 1,
        discount=np.where(one + 2 * two > 0, one / np.maximum(one + 2 * two, 1), 0.5).clip(0.1, 0.9),
        total=of[1]["total"].to_numpy(), kinds=of[1]["kinds"].to_numpy(),
    )
    rows = []
    for m, df in enumerate(levels, 1):
        rows.append(df.select(F.lit(m).alias("m"), F.lit(False).alias("context"), "lang", "ctx", "sym", F.col("n").cast("double").alias("count"), F.lit(0.0).alias("kinds")))
        if m > 1:
            contexts = df.groupBy("lang", "ctx").agg(F.sum("n").cast("double").alias("count"), F.count(F.lit(1)).cast("double").alias("kinds"))
            rows.append(contexts.select(F.lit(m).alias("m"), F.lit(True).alias("context"), "lang", "ctx", F.lit(0).alias("sym"), "count", "kinds"))
    keyed = reduce(union, rows).mapInArrow(_key_batches(languages, bits), "part int, key bigint, lang int, count double, kinds double")
    keyed.repartitionByRange(1 << bits, "part").sortWithinPartitions("part", "key").write.partitionBy("part").parquet(model.folder)
    return model


def _text_hash() -> Column:
    return F.xxhash64(F.col("l"), F.col("t"))


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(l, h, copies) of the distinct texts learned from."""
    rows = docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).filter("t is not null and l is not null")
    return stored(rows.groupBy("l", _text_hash().alias("h")).agg(F.count(F.lit(1)).alias("copies")), "texts")


def _left_out(rows: DataFrame, model: StoredModel, texts: DataFrame) -> DataFrame:
    """``rows`` (.., t, l) with ``h``, the hash of language and text, and ``p``:
    LEFT. The counts of up to ``COPIED`` texts with copies are broadcast, so
    that texts need no shuffle; more are joined."""
    rows = rows.withColumn("l", F.col("l").cast("string")).withColumn("h", _text_hash())
    copied = stored(texts.filter("copies > 1").groupBy("h").agg(F.max("copies").alias("copies")), "copied")
    rows = rows.join(F.broadcast(copied) if copied.count() <= COPIED else copied, "h", "left")
    copies = F.when(F.col("l").isNotNull() & F.col("t").isNotNull(), F.coalesce("copies", F.lit(1)))
    return rows.withColumn("p", _predictor(rows.sparkSession, model, True)(F.col("t"), F.col("l"), copies)).drop("copies", "t")


def _calibrate(model: StoredModel, seen: DataFrame, slack: float, quantile: float, least_margin: float) -> None:
    """Limits from texts (l, entropy, n) that were not counted: what an
    entropy is above the usual one may be ``slack`` times the ``quantile`` of
    theirs, at least ``least_margin``, and three times the usual entropy over
    the root of its length more."""
    mean = seen.groupBy("l").agg((F.sum(F.col("entropy") * F.col("n")) / F.sum("n")).alias("usual")).toPandas()  # a row per language
    usual = pd.Series(mean["usual"].to_numpy(dtype=float), mean["l"]).reindex(model.languages).round(9)
    above = F.col("entropy") - _by_language(model.languages, usual.fillna(0.0))[F.col("l")]
    high = exact_quantile(seen.select(above.alias("above")), "above", quantile)
    model.usual, model.spread, model.limit = usual.fillna(0.0).to_numpy(), usual.fillna(np.inf).to_numpy(), 3.0
    model.allowed = slack * max(least_margin, round(high or 0.0, 9))


def _by_language(languages: list[str], values) -> Column:
    return F.create_map(*[F.lit(x) for pair in zip(languages, map(float, values), strict=True) for x in pair])


def _calibrate_left_out(model: StoredModel, scored: DataFrame, texts: DataFrame, slack: float = 3.0, least_texts: int = 64, quantile: float = 0.999, least_margin: float = 0.5) -> None:
    """Calibration by all rows of ``_left_out``: of every language with
    ``least_texts`` distinct texts, each distinct text that is still nearest to
    its own language without itself. Other languages reject nothing."""
    enough = texts.groupBy("l").count().filter(F.col("count") >= least_texts).select("l")  # a row per language
    seen = scored.filter("p.left <= p.others and p.n > 0").join(F.broadcast(enough), "l", "left_semi")
    seen = seen.groupBy("l", "h").agg(F.min("p.left").alias("entropy"), F.min("p.n").alias("n"))
    _calibrate(model, stored(seen, "calibration"), slack, quantile, least_margin)


def learn_and_identify(docs: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None, **settings) -> tuple[StoredModel, DataFrame]:
    """The model that ``fit`` with ``leave_out`` learns from ``docs``, and
    (row, prediction): the rows of ``docs`` as structs (of the columns ``keep``),
    with what ``identify`` gives for each. Every text is scored once, for both."""
    model, texts = store_model(count_ngrams(docs, text, lang)), _texts(docs, text, lang)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in keep or docs.columns]).alias("row"), F.col(text).alias("t"), F.col(lang).alias("l"))
    if not model.languages:
        return model, identify(rows, model, "t").select("row", "prediction")
    scored = stored(_left_out(rows, model, texts), "predictions")
    _calibrate_left_out(model, scored, texts, **{k: v for k, v in settings.items() if k != "leave_out"})
    usual, spread = (_by_language(model.languages, x)[F.col("p.lang")] for x in (model.usual, model.spread))
    usually = (F.col("p.entropy") - usual - model.allowed) * F.sqrt("p.n") <= model.limit * spread
    accepted = F.col("p.accepted") & F.coalesce(usually, F.lit(False))
    return model, scored.select("row", F.struct("p.lang", "p.score", "p.entropy", "p.n", accepted.alias("accepted")).alias("prediction"))


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    calibration_rows: int | None = None,
    slack: float = 3.0,
    apart: int = 0,
    least_texts: int = 64,
    quantile: float = 0.999,
    least_margin: float = 0.5,
    leave_out: bool = False,
) -> LanguageModel:
    """Models of all languages in ``docs``.

    Counts cover every row and n-gram but those kept apart. All distinct texts
    set the usual entropy; with ``calibration_rows`` only about so many of
    every language, chosen by a hash. A language without a correctly
    predicted text among its own has no calibration and rejects nothing.

    With ``leave_out``, as the query and the pipeline learn, counts cover every
    row, and every text calibrates with itself and its copies left out of them
    (``_calibrate_left_out``). With ``apart``, one of so many distinct texts of a language that has about
    ``least_texts`` is kept out of the counts, and only such texts calibrate,
    in the same way. Other languages reject nothing. Without either,
    training texts calibrate: the limit is ``slack`` times the largest
    deviation among them.
    """
    if leave_out:
        model, texts = store_model(count_ngrams(docs, text, lang)), _texts(docs, text, lang)
        if model.languages:
            rows = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).filter("t is not null and l is not null")
            scored = stored(_left_out(rows, model, texts), "predictions")
            _calibrate_left_out(model, scored, texts, slack, least_texts, quantile, least_margin)
        return model
    rows = docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).filter("t is not null and l is not null")
    rows = rows.withColumn("h", F.xxhash64("t"))
    known = rows.groupBy("l").agg(F.approx_count_distinct("h").alias("texts"))  # a row per language
    counted = docs
    if apart:
        known = stored(known.filter(F.col("texts") >= least_texts), "languages")
        names = [r.l for r in known.collect()]
        kept = lambda t, l: l.isin(names) & (F.pmod(F.xxhash64(t), F.lit(apart)) == 0)
        counted = docs.filter(~F.coalesce(kept(F.col(text), F.col(lang).cast("string")), F.lit(False)))
        rows = rows.filter(kept(F.col("t"), F.col("l")))
    model = store_model(count_ngrams(counted, text, lang))
    if not model.languages:
        return model
    if calibration_rows is not None:
        share = known.select("l", (F.lit(calibration_rows * max(apart, 1)) / F.col("texts")).alias("share"))
        rows = rows.join(F.broadcast(share), "l").filter((F.col("share") >= 1) | (F.col("h") / 2.0**64 + 0.5 < F.col("share")))
    small = model_only(rows.sparkSession, model)
    seen = rows.select(small(F.col("t")).alias("p"), "l", "h").filter("p.lang = l and p.n > 0")
    seen = stored(seen.select("l", "h", "p.entropy", "p.n").distinct(), "calibration")
    if apart:
        _calibrate(model, seen, slack, quantile, least_margin)
        return model
    mean = seen.groupBy("l").agg((F.sum(F.col("entropy") * F.col("n")) / F.sum("n")).alias("usual")).toPandas()
    usual = pd.Series(mean["usual"].to_numpy(dtype=float), mean["l"]).reindex(model.languages).round(9).fillna(0.0).to_numpy()
    z = (F.col("entropy") - _by_language(model.languages, usual)[F.col("l")]) * F.sqrt("n")
    found = seen.groupBy("l").agg(F.sqrt(F.avg(z * z)).alias("spread"), F.max(z).alias("most")).toPandas().set_index("l").reindex(model.languages)
    spread = found["spread"].round(9).clip(lower=0.5)
    most = (found["most"] / spread).max()
    model.usual, model.spread = usual, spread.fillna(np.inf).to_numpy()
    model.limit = slack * max(6.0, 0.0 if np.isnan(most) else float(most))
    return model


RESULT = "lang string, score double, entropy double, n bigint, accepted boolean"
#: ``left``: entropy by the language stated, without the text; ``others``: the least by any other.
LEFT = RESULT + ", left double, others double"


def _predictor(spark, model: LanguageModel, left_out: bool = False):
    """A function of a text column that gives a struct of RESULT, or with
    ``left_out`` of text, language learned and copies that gives LEFT. The
    last two fields alone depend on the language learned."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))

    def rows(m: LanguageModel, letters: np.ndarray, names: np.ndarray, texts: list[str], own: np.ndarray | None, copies: np.ndarray | None) -> pd.DataFrame:
        n, h, lettered, *left = m.entropies(texts, letters) if own is None else m.left_out(texts, letters, own, copies)
        every = np.arange(len(texts))
        best = h.argmin(axis=1)
        low = h[every, best]
        score = 1 / np.exp(-np.minimum((h - low[:, None]) * n[:, None], 700)).sum(axis=1)
        ok = lettered.copy()
        if m.usual is not None:
            ok &= (low - m.usual[best] - m.allowed) * np.sqrt(n) <= m.limit * m.spread[best]
        best = np.where(lettered, best, len(m.languages))
        out = pd.DataFrame({"lang": names[best], "score": np.where(lettered, score, 0.0), "entropy": np.where(lettered, low, 0.0), "n": n, "accepted": ok})
        if own is not None:
            h[every, own] = np.where(own >= 0, np.inf, h[every, own])
            out["left"], out["others"] = np.where(lettered, left[0], np.nan), h.min(axis=1)
        return out

    def predict(texts: pd.Series, own: pd.Series | None, copies: pd.Series | None, m: LanguageModel, letters: np.ndarray) -> pd.DataFrame:
        names = np.array([*m.languages, UNKNOWN], dtype=object)
        at = {x: i for i, x in enumerate(m.languages)}
        texts = [t or "" for t in texts]
        if own is not None:
            copies = copies.fillna(0).to_numpy(dtype=np.int64)
            own = np.where(copies > 0, [at.get(x, -1) for x in own], -1)
        most = 4 * PIECE // max(4, len(m.languages))
        parts = [rows(m, letters, names, texts[i:j], None if own is None else own[i:j], None if own is None else copies[i:j]) for i, j in (pieces(texts, most) if m.languages else ())]
        if parts:
            return pd.concat(parts, ignore_index=True)
        return pd.DataFrame({"lang": UNKNOWN, "score": 0.0, "entropy": 0.0, "n": 0, "accepted": False}, index=range(len(texts)))

    def plain(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, letters = pickle.loads(sent.value), letter_table()
        for texts in series:
            yield predict(texts, None, None, m, letters)

    def without(series: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m, letters = pickle.loads(sent.value), letter_table()
        for texts, own, copies in series:
            out = predict(texts, own, copies, m, letters)
            yield out if "left" in out else out.assign(left=np.nan, others=0.0)

    # else a filter on the result would be pushed below and evaluate it again
    return F.pandas_udf(without if left_out else plain, LEFT if left_out else RESULT).asNondeterministic()


def model_only(spark, model: LanguageModel):
    """A function of a text column that gives a struct of RESULT."""
    return _predictor(spark, model)


def held_out(key: Column) -> Column:
    """Every fourth document, by the CRC-32 of its id's text, is never learned from."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "prediction") -> DataFrame:
    """``docs`` with a struct column ``out``: lang, score, entropy, n, accepted.
    A column that ``docs`` has by that name is replaced. Null texts and texts
    without a letter are ``und`` with score 0 and not accepted."""
    return docs.withColumn(out, model_only(docs.sparkSession, model)(F.col(text)))
