"""N-gram Jaccard join: grouped prefix join with exact verification.

A document's set is its distinct word shingles. Two documents of similarity t
or more share a token among the first ``n - ceil(t n) + 1`` of each set, in any
order of tokens common to all sets. Here rarer tokens come first: tokens are
counted over all documents, the frequent ones (at most ``max_frequent``, the
bound of what is broadcast) go last by rising count, all others by hash; the
choice only affects speed.

1. Equal sets are one class. Classes with the same size and the same prefix
   form one group; only groups are posted under their prefix tokens.
2. Under each token groups are paired and filtered by size and by the position
   of the token. Lists of up to ``all_pairs`` groups give all their pairs;
   longer ones give a star per size class and are kept. Tokens in more than
   ``hot`` documents are dealt to salted buckets, their members to a block.
3. Group pairs are expanded to class pairs (a large product again to stars and
   a block) and verified on the whole sets: first one pair of each class,
   then, of the others, those between the components that these make.
4. The long lists are gone through again: every pair of classes that passes
   the filters, and a bound from parity sketches of the sets, and is still in different components is verified too, as is
   every pair of a block. A pair comes from the list of the first token that
   both prefixes hold, not from each list that both are in; and of each list
   the nearest pair of each class comes first, so that of a large group of near
   copies only pairs that these have not joined are left for the second time. So any two linked documents end in one component,
   though not every pair of a large group of copies is compared.

Sets are compared by hashes of their shingles: 64 bits, of which 48 travel.

Defined results: null or wordless texts have no shingle, belong to no class
and link with nothing. Repeated rows and equal texts are one class. Null ids
take part; a component's id is its least id that is not null. An empty table
gives no rows. Extra columns are ignored by ``link_components`` and carried by
``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pack, stored
from .components import component_roots
from .shingles import Hasher, U, mix, pieces

SALTS = 16
KEEP = U(16)  # bits of a token hash that do not travel


def least_overlap(total: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least intersection of two sets with ``total`` members together that
    reaches num/den."""
    return -(-num * total // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def set_hash(tokens: np.ndarray) -> int:
    """63-bit hash of a set, whatever its order."""
    return int(np.add.reduce(mix(tokens * U(0x9E3779B97F4A7C15) + U(1)), dtype=np.uint64) >> U(1))


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """512 bits in 8 numbers: of each part of the hash space, whether it holds
    an odd number of the set's members. Two sets differ in at least as many
    members as their sketches in bits."""
    odd = np.bincount((tokens >> U(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


SKETCH = [f"s{i}" for i in range(8)]


def each_set(hasher: Hasher, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """Index and ascending distinct shingles of each text that has any."""
    for at, end in pieces(texts):
        tokens, offsets = hasher.shingles(texts[at:end])
        for i in range(end - at):
            if offsets[i] < offsets[i + 1]:
                yield at + i, np.unique(tokens[offsets[i] : offsets[i + 1]])


class TokenOrder:
    """Sort keys that put frequent tokens last, by rising count."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray):
        order = np.argsort(frequent)
        self.frequent, self.counts = frequent[order], counts[order]
        self.rank = np.empty(len(order), dtype=np.uint64)
        self.rank[np.lexsort((self.frequent, self.counts))] = np.arange(len(order), dtype=np.uint64)
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.frequent >> U(28)] = True  # the leading 20 of 48 bits

    def keys(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key and count (0: not frequent) of every token."""
        short = tokens >> KEEP
        keys, counts = tokens >> U(1), np.zeros(len(tokens), dtype=np.int64)
        look = np.flatnonzero(self.maybe[short >> U(28)])
        if len(look):
            at = np.minimum(np.searchsorted(self.frequent, short[look]), len(self.frequent) - 1)
            hit = self.frequent[at] == short[look]
            look, at = look[hit], at[hit]
            keys[look] = U(1 << 63) | self.rank[at]
            counts[look] = self.counts[at]
        return keys, counts


def _planes(tokens: np.ndarray) -> bytes:
    """48-bit numbers: all low 32 bits, then all high 16."""
    return tokens.astype(np.uint32).tobytes() + (tokens >> U(32)).astype(np.uint16).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, np.uint32, n).astype(np.uint64) | (np.frombuffer(data, np.uint16, n, 4 * n).astype(np.uint64) << U(32))


# --- token counts ----------------------------------------------------------


def _token_batches(width: int, bits: int, most: int = 1_500_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(width)
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            t = np.sort(np.concatenate(held))
            cut = np.searchsorted(t, np.arange(1 << bits, dtype=np.uint64) << U(48 - bits)) if bits else np.zeros(1, dtype=np.int64)
            blobs = [_planes(x) for x in np.split(t, cut[1:])]
            return pa.RecordBatch.from_arrays([pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "tokens"])

        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for at, end in pieces(texts):
                held.append(hasher.shingles(texts[at:end])[0] >> KEEP)
                if sum(map(len, held)) >= most:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return run


def _count_bucket(least: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        t = np.sort(np.concatenate([_from_planes(x) for x in table.column("tokens").to_pylist()]))
        first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, dtype=np.int64)
        n = np.diff(np.concatenate((first, [len(t)])))
        keep = n >= least
        return pa.table({"token": pa.array(t[first[keep]].astype(np.int64)), "n": pa.array(n[keep].astype(np.int64))})

    return run


def frequent_tokens(texts: DataFrame, width: int, bits: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and counts of those that occur ``least`` times or more in all
    texts, the ``most`` frequent of them. Tokens travel packed, sorted and bucketed by hash."""
    packed = texts.mapInArrow(_token_batches(width, bits), "bucket int, tokens binary")
    counts = packed.groupBy("bucket").applyInArrow(_count_bucket(least), "token bigint, n bigint")
    top = counts.orderBy(F.col("n").desc(), "token").limit(most).toPandas()
    return top["token"].to_numpy(dtype=np.int64).astype(np.uint64), top["n"].to_numpy(dtype=np.int64)


# --- sets, classes, groups -------------------------------------------------


def _set_info(sent, width: int, num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, order = Hasher(width), TokenOrder(*sent.value)
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            n, c, g = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            sketch, lead = np.zeros((8, len(texts)), np.int64), [None] * len(texts)
            for i, tokens in each_set(hasher, texts):
                keys, counts = order.keys(tokens)
                n[i], c[i], sketch[:, i] = len(tokens), set_hash(tokens), parity_sketch(tokens)
                p = prefix_length(len(tokens), num, den)
                first = np.argpartition(keys, p - 1)[:p]
                g[i] = group_hash(keys[first], len(tokens))
                often = first[counts[first] > 0]
                if len(often):
                    lead[i] = _planes(tokens[often[np.argsort(keys[often])]] >> KEEP)
            columns = [batch.column(0), pa.array(n), pa.array(c, mask=n == 0), pa.array(g, mask=n == 0), *map(pa.array, sketch), pa.array(lead, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "c", "g", *SKETCH, "lead"])

    return run


def group_hash(prefix: np.ndarray, size: int) -> int:
    """63-bit hash of a prefix, as a set, and a size."""
    return (set_hash(prefix) * 0x9E3779B1 + size * 0x85EBCA77) & ((1 << 63) - 1)


def _posting_batches(sent, width: int, num: int, den: int, bits: int, hot: int, most: int = 400_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, order = Hasher(width), TokenOrder(*sent.value)
        seen: set[int] = set()
        held: list[tuple] = []
        rows = 0

        def out() -> pa.RecordBatch:
            token, group, size, place, count = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (token >> U(48 - bits)).astype(np.int64)
            salted = count > hot  # a bucket of its own for each salt
            bucket[salted] = (1 << bits) + bucket[salted] * SALTS + group[salted] % SALTS
            by = np.argsort(bucket, kind="stable")
            bucket = bucket[by]
            at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            cut = at[1:]
            columns = [[_planes(x) for x in np.split(token[by], cut)], *[[x.tobytes() for x in np.split(a[by], cut)] for a in (group, size, place)]]
            return pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int64()), *[pa.array(x, pa.binary()) for x in columns]], ["bucket", "tokens", "groups", "sizes", "places"])

        for batch in batches:
            for _, tokens in each_set(hasher, batch.column(0).cast(pa.binary()).to_pylist()):
                keys, counts = order.keys(tokens)
                p = prefix_length(len(tokens), num, den)
                first = np.argpartition(keys, p - 1)[:p]
                first = first[np.argsort(keys[first])]
                g = group_hash(keys[first], len(tokens))
                if g in seen:
                    continue
                seen.add(g)
                if len(seen) > 1_000_000:
                    seen.clear()
                held.append((tokens[first] >> KEEP, np.full(p, g, np.int64), np.full(p, len(tokens), np.int32), np.arange(p, dtype=np.int32), counts[first]))
                rows += p
                if rows >= most:
                    yield out()
                    held.clear()
                    rows = 0
        if held:
            yield out()

    return run


PAIR, BLOCK, HUB, LIST = 0, 1, 2, 3
FOUND = "kind int, a bigint, b bigint, bucket bigint, members binary"
MEMBER = np.dtype([("group", np.int64), ("size", np.int32), ("place", np.int32)])


def _pair_bucket(num: int, den: int, all_pairs: int, bits: int) -> Callable[[pa.Table], pa.Table]:
    """Group pairs, the long lists with the groups in them, and the hubs of
    salted lists. FOUND's rows: a pair (a, b); a list (a: token) with packed
    members, and the groups (b) of all long lists of the bucket; a group (b)
    of a salted list (a); a hub (b) of a salted list (a)."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        token = np.concatenate([_from_planes(x) for x in table.column("tokens").to_pylist()])
        group, size, place = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("groups", np.int64), ("sizes", np.int32), ("places", np.int32)))
        size, place = size.astype(np.int64), place.astype(np.int64)
        by = np.lexsort((size, group, token))
        token, group, size, place = token[by], group[by], size[by], place[by]
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (group[1:] != group[:-1]) | (size[1:] != size[:-1])))
        token, group, size, place = token[new], group[new], size[new], place[new]
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        length = np.diff(np.concatenate((start, [len(token)])))
        kinds, left, right, packed = [], [], [], []

        def emit(kind: int, a: np.ndarray, b: np.ndarray) -> None:
            by = np.lexsort((b, a))
            a, b = a[by], b[by]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, dtype=bool)
            kinds.append(np.full(int(new.sum()), kind, dtype=np.int32))
            left.append(a[new])
            right.append(b[new])

        def pairs(i: np.ndarray, j: np.ndarray) -> None:
            m, n = size[i], size[j]
            rest = np.minimum(m - place[i], n - place[j])
            ok = (np.minimum(m, n) * den >= np.maximum(m, n) * num) & (rest >= least_overlap(m + n, num, den)) & (group[i] != group[j])
            a, b = group[i[ok]], group[j[ok]]
            emit(PAIR, np.minimum(a, b), np.maximum(a, b))

        for k in np.unique(length[(length > 1) & (length <= all_pairs)]):
            x, y = np.triu_indices(k, 1)
            own = start[length == k]
            step = max(1, 300_000 // len(x))
            for at in range(0, len(own), step):
                rows = own[at : at + step, None]
                pairs((rows + x).ravel(), (rows + y).ravel())
        long = np.flatnonzero(length > all_pairs)
        if len(long):
            members = [np.arange(start[i], start[i] + length[i]) for i in long]
            for m in members:  # a star per size class; its centre is the least group
                step = np.floor(np.log(size[m]) / np.log(den / num)).astype(np.int64)
                by = np.lexsort((group[m], step))
                m, step = m[by], step[by]
                head = np.flatnonzero(np.concatenate(([True], step[1:] != step[:-1])))
                centre = np.repeat(m[head], np.diff(np.concatenate((head, [len(m)]))))
                a, b = group[centre], group[m]
                emit(PAIR, np.minimum(a, b)[a != b], np.maximum(a, b)[a != b])
                if bucket >= 1 << bits:
                    emit(HUB, np.full(len(head), token[m[0]].astype(np.int64)), group[m[head]])
            if bucket < 1 << bits:
                names = np.unique(group[np.concatenate(members)])
                emit(LIST, np.full(len(names), -1), names)
                for m in members:
                    entry = np.empty(len(m), dtype=MEMBER)
                    entry["group"], entry["size"], entry["place"] = group[m], size[m], place[m]
                    packed.append((int(token[m[0]]), entry.tobytes()))
        if bucket >= 1 << bits:  # parts of one list lie in several buckets
            emit(BLOCK, -1 - token.astype(np.int64), group)
        kind = np.concatenate([*kinds, np.full(len(packed), LIST, dtype=np.int32)])
        a = np.concatenate([*left, np.array([t for t, _ in packed], dtype=np.int64)])
        b = np.concatenate([*right, np.full(len(packed), -1, dtype=np.int64)])
        blobs = pa.array([None] * (len(kind) - len(packed)) + [x for _, x in packed], pa.binary())
        return pa.table({"kind": pa.array(kind), "a": pa.array(a), "b": pa.array(b), "bucket": pa.array(np.full(len(kind), bucket)), "members": blobs})

    return run


def _open_pairs(num: int, den: int, nearest: bool = False) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a bucket's long lists, the class pairs in different components that
    pass the filters, that of their parity sketches included. Right: (g, c,
    root, sketch, lead) of the lists' groups; ``lead``: the frequent tokens of
    the prefix, in order. A pair with a common one before the list's token is
    left to that one's list: there it passes if it is linked, as the bound by
    place is widest at the first token in common. With ``nearest`` only one
    pair of each class outside the list's largest component, by the sketches."""

    def run(lists: pa.Table, known: pa.Table) -> pa.Table:
        g, c, root = (known.column(x).to_numpy() for x in ("g", "c", "root"))
        by = np.argsort(g, kind="stable")
        g, c, root = g[by], c[by], root[by]
        leads = known.column("lead").combine_chunks().take(pa.array(by))
        lead_of: dict[int, list[int]] = {}

        def before(token: int, group: int, row: int) -> frozenset[int]:
            if group not in lead_of:
                lead_of[group] = _from_planes(leads[row].as_py() or b"").tolist()
            lead = lead_of[group]
            return frozenset(lead[: lead.index(token)] if token in lead else ())

        sketch = np.stack([known.column(x).to_numpy() for x in SKETCH], axis=1)[by].view(np.uint64)
        out: list[np.ndarray] = []
        for token, blob in zip(lists.column("token").to_pylist(), lists.column("members").to_pylist(), strict=True):
            entry = np.frombuffer(blob, dtype=MEMBER)
            low, high = np.searchsorted(g, entry["group"]), np.searchsorted(g, entry["group"], side="right")
            k = high - low  # classes of each group
            at = np.repeat(low - np.concatenate(([0], np.cumsum(k)[:-1])), k) + np.arange(k.sum())
            r, who, bits = root[at], c[at], sketch[at]
            n, rest = np.repeat(entry["size"].astype(np.int64), k), np.repeat((entry["size"] - entry["place"]).astype(np.int64), k)
            names, part, sizes = np.unique(r, return_inverse=True, return_counts=True)
            if len(names) < 2:
                continue
            main = part == sizes.argmax()
            few = np.flatnonzero(~main)  # whatever pair is open has one of these
            earlier: dict[int, frozenset[int]] = {}
            step = max(1, 2_000_000 // len(r))
            for start in range(0, len(few), step):
                i = few[start : start + step, None]
                ok = (part[i] != part) & (main | (i < np.arange(len(r))))
                ok &= np.minimum(n[i], n) * den >= np.maximum(n[i], n) * num
                ok &= np.minimum(rest[i], rest) >= least_overlap(n[i] + n, num, den)
                x, y = np.nonzero(ok)
                x = i[x, 0]
                # sets that reach the similarity differ in no more members than this
                most = n[x] + n[y] - 2 * least_overlap(n[x] + n[y], num, den)
                apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
                near = apart <= most
                x, y, apart = x[near], y[near], apart[near]
                for i in np.unique(np.concatenate((x, y))).tolist():
                    if i not in earlier:
                        earlier[i] = before(token, int(g[at[i]]), int(at[i]))
                own = np.fromiter((earlier[i].isdisjoint(earlier[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)), bool, len(x))
                x, y = x[own], y[own]
                if nearest:
                    by = np.lexsort((who[y], apart[own], x))
                    x, y = x[by], y[by]
                    first = np.concatenate(([True], x[1:] != x[:-1])) if len(x) else np.zeros(0, dtype=bool)
                    x, y = x[first], y[first]
                out.append(np.stack([np.minimum(who[x], who[y]), np.maximum(who[x], who[y])]))
        both = np.concatenate(out, axis=1) if out else np.zeros((2, 0), dtype=np.int64)
        by = np.lexsort(both)
        both = both[:, by]
        new = np.concatenate(([True], (both[:, 1:] != both[:, :-1]).any(axis=0))) if len(by) else np.zeros(0, dtype=bool)
        return pa.table({"x": pa.array(both[0][new], pa.int64()), "y": pa.array(both[1][new], pa.int64())})

    return run


# --- verification ----------------------------------------------------------


def _class_tokens(sent, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, wanted = Hasher(width), sent.value if sent else None
        done: set[int] = set()
        for batch in batches:
            names, blobs = [], []
            for _, tokens in each_set(hasher, batch.column(0).cast(pa.binary()).to_pylist()):
                c = set_hash(tokens)
                if wanted is not None:
                    at = np.searchsorted(wanted, c)
                    if at == len(wanted) or wanted[at] != c:
                        continue
                if c in done:
                    continue
                done.add(c)
                if len(done) > 1_000_000:
                    done.clear()
                names.append(c)
                blobs.append(_planes(np.sort(tokens >> KEEP)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["c", "tokens"])

    return run


def class_sets(texts: DataFrame, pairs: DataFrame, width: int, max_wanted: int) -> DataFrame:
    """(c, tokens) of the classes in class pairs (a, b), stored.

    Sets are made again from the texts. Up to ``max_wanted`` class ids are
    broadcast for that; beyond it all sets are joined with the ids instead.
    """
    spark = texts.sparkSession
    ids = stored(pairs.select("a").union(pairs.select("b")).distinct(), "wanted")
    sent = None
    if ids.count() <= max_wanted:
        sent = spark.sparkContext.broadcast(np.sort(ids.toPandas()["a"].to_numpy(dtype=np.int64)))
    sets = texts.mapInArrow(_class_tokens(sent, width), "c bigint, tokens binary")
    if sent is None:
        sets = sets.join(ids.withColumnRenamed("a", "c"), "c", "left_semi")
    return stored(sets.dropDuplicates(["c"]), "class-sets")


def more_sets(sets: DataFrame, texts: DataFrame, pairs: DataFrame, width: int, max_wanted: int) -> DataFrame:
    """(c, tokens) of the classes in class pairs (a, b), stored: from ``sets``,
    and those that it lacks from the texts."""
    ids = stored(pairs.select("a").union(pairs.select("b")).distinct().toDF("c"), "wanted-again")
    new = stored(ids.join(sets.select("c"), "c", "left_anti").select(F.col("c").alias("a"), F.col("c").alias("b")), "wanted-new")
    known = sets.join(ids, "c", "left_semi")
    return stored(known.union(class_sets(texts, new, width, max_wanted)) if new.limit(1).count() else known, "class-sets")


def verify(sets: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Of class pairs (a, b), those whose whole sets reach the similarity."""

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x), dtype=bool)
        for i, (p, q) in enumerate(zip(x, y, strict=True)):
            a, b = _from_planes(p), _from_planes(q)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out[i] = den * both >= num * (len(a) + len(b) - both)
        return pd.Series(out)

    first = pairs.join(sets.select(F.col("c").alias("a"), F.col("tokens").alias("x")), "a")
    both = first.join(sets.select(F.col("c").alias("b"), F.col("tokens").alias("y")), "b")
    return stored(both.filter(similar("x", "y")).select("a", "b"), "linked-pairs")


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose classes lie in different components, which are (ra, rb)."""
    for side in ("a", "b"):
        own = roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
        pairs = pairs.join(own, side, "left").withColumn(f"r{side}", F.coalesce(f"r{side}", side))
    return pairs.filter("ra <> rb")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after further verified links (a, b): only the components are
    linked anew, so an edge is one between components."""
    edges = stored(_across(links, roots).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "component-links")
    if not edges.limit(1).count():
        return roots
    upper = component_roots(edges).select(F.col("node").alias("root"), F.col("root").alias("top"))
    known = roots.union(roots.select("root", "root")).union(edges.select("a", "a")).union(edges.select("b", "b")).distinct()
    known = known.toDF("node", "root").join(upper, "root", "left")
    return stored(known.select("node", F.coalesce("top", "root").alias("root")).groupBy("node").agg(F.min("root").alias("root")), "roots")


# --- the join --------------------------------------------------------------


def _bits(texts: DataFrame) -> int:
    """Buckets (as a power of 2) of about a million tokens each."""
    chars = texts.agg(F.sum(F.length("t"))).first()[0] or 0
    return min(20, max(3, int(chars // 6_000_000).bit_length()))


def link_components(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    num: int = 80,
    den: int = 100,
    width: int = 5,
    max_frequent: int = 500_000,
    frequent: int = 9,
    all_pairs: int = 8,
    hot: int = 50_000,
    max_wanted: int = 2_000_000,
) -> DataFrame:
    """Per row of ``docs``: id, ``n`` (set size), ``c`` (63-bit class id, null
    for an empty set), ``root`` (class id that names the component) and
    ``component_id``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    texts = rows.filter("t is not null").select("t")
    bits = _bits(texts)
    order = spark.sparkContext.broadcast(frequent_tokens(texts, width, bits, frequent, max_frequent))

    kind = rows.schema["id"].dataType.simpleString()
    info = stored(rows.mapInArrow(_set_info(order, width, num, den), f"id {kind}, n bigint, c bigint, g bigint, " + ", ".join(f"{x} bigint" for x in SKETCH) + ", lead binary"), "set-info")
    classes = stored(info.filter("c is not null").groupBy("c").agg(F.min("id").alias("id"), F.min("g").alias("g"), F.min("n").alias("n"), *[F.min(x).alias(x) for x in SKETCH]), "classes")

    posted = texts.mapInArrow(_posting_batches(order, width, num, den, bits, hot), "bucket bigint, tokens binary, groups binary, sizes binary, places binary")
    found = stored(posted.groupBy("bucket").applyInArrow(_pair_bucket(num, den, all_pairs, bits), FOUND), "group-pairs")
    groups = classes.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("rep"))
    several = stored(groups.filter("k > 1"), "groups-of-several")

    # pairs of groups: in the buckets, and between the centres of salted parts
    hubs = found.filter(F.col("kind") == HUB).select("a", "b").distinct()
    centre = hubs.groupBy("a").agg(F.min("b").alias("m"))
    linked = hubs.join(centre, "a").filter("m <> b").select(F.col("m").alias("a"), "b")
    pairs = found.filter(F.col("kind") == PAIR).select("a", "b").union(linked).distinct()
    # to pairs of classes: reps stand for groups of one
    sized = pairs.join(groups.select(F.col("g").alias("a"), F.col("k").alias("ka"), F.col("rep").alias("ra")), "a")
    sized = sized.join(groups.select(F.col("g").alias("b"), F.col("k").alias("kb"), F.col("rep").alias("rb")), "b")
    sized = stored(sized, "sized-pairs")
    member = classes.select("g", "c")
    single = sized.filter("ka = 1 and kb = 1").select(F.col("ra").alias("x"), F.col("rb").alias("y"))
    multiple = sized.filter("ka > 1 or kb > 1")
    small = multiple.filter("ka * kb <= 64")
    x = small.join(member.select(F.col("g").alias("a"), F.col("c").alias("x")), "a")
    full = x.join(member.select(F.col("g").alias("b"), F.col("c").alias("y")), "b").select("x", "y")
    large = multiple.filter("ka * kb > 64")
    star = large.join(member.select(F.col("g").alias("b"), F.col("c").alias("y")), "b").select(F.col("ra").alias("x"), "y")
    inside = several.join(member, "g").filter("c <> rep").select(F.col("rep").alias("x"), F.col("c").alias("y"))
    wide = single.union(full).union(star).union(inside)
    ordered = lambda d: d.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    candidates = stored(ordered(wide), "class-pairs")
    sets = class_sets(texts, candidates, width, max_wanted)
    # a class of a large group of near copies is in several stars: one pair of
    # each class comes first, and of the others those still across components
    first = stored(candidates.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first-pairs")
    roots = stored(component_roots(verify(sets, first, num, den)), "roots")
    second = stored(_across(candidates.join(first, ["a", "b"], "left_anti"), roots).select("a", "b"), "second-pairs")
    roots = _merged(roots, verify(sets, second, num, den))

    # what stars have left out: pairs of a list or block in different components
    leads = info.filter("lead is not null").groupBy("g").agg(F.min("lead").alias("lead"))  # follows from the prefix: one of each group
    lists = found.filter(F.col("kind") == LIST)
    listed = lists.filter("members is null").select(F.col("bucket").alias("at"), F.col("b").alias("g")).join(leads, "g", "left")
    lists = lists.filter("members is not null").select("bucket", F.col("a").alias("token"), "members")

    def rooted() -> DataFrame:
        own = classes.select("g", "c", "n", *SKETCH).join(roots.withColumnRenamed("node", "c"), "c", "left")
        return own.select("g", "c", "n", F.coalesce("root", "c").alias("root"), *SKETCH)

    def open_pairs(nearest: bool) -> DataFrame:
        seen = listed.join(rooted(), "g").select("at", "g", "c", "root", *SKETCH, "lead")
        return lists.groupBy("bucket").cogroup(seen.groupBy("at")).applyInArrow(_open_pairs(num, den, nearest), "x bigint, y bigint")

    near = stored(ordered(open_pairs(True)).join(candidates, ["a", "b"], "left_anti"), "near-pairs")
    if near.limit(1).count():
        roots = _merged(roots, verify(more_sets(sets, texts, near, width, max_wanted), near, num, den))
    blocks = found.filter(F.col("kind") == BLOCK).select(F.xxhash64("kind", "a").alias("block"), F.col("b").alias("g"))
    blocks = blocks.union(large.select(F.xxhash64("a", "b").alias("block"), F.explode(F.array("a", "b")).alias("g")))
    blocks = blocks.union(several.filter("k > 2").select(F.xxhash64(F.lit("group"), "g").alias("block"), "g")).distinct()
    rest = blocks.join(rooted(), "g").select("block", "c", "n", "root")
    mixed = rest.groupBy("block").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("block")
    rest = stored(rest.join(mixed, "block"), "open-blocks")
    other = rest.select("block", F.col("c").alias("y"), F.col("n").alias("m"), F.col("root").alias("r"))
    cross = rest.join(other, "block").filter((F.col("root") < F.col("r")) & (F.least("n", "m") * den >= F.greatest("n", "m") * num))
    cross = ordered(cross.select(F.col("c").alias("x"), "y").union(open_pairs(False))).join(candidates.union(near), ["a", "b"], "left_anti")
    cross = stored(cross, "open-pairs")
    if cross.limit(1).count():
        roots = _merged(roots, verify(more_sets(sets, texts, cross, width, max_wanted), cross, num, den))

    named = classes.join(roots.withColumnRenamed("node", "c"), "c", "left").select("c", "id", F.coalesce("root", "c").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = stored(named.select("c", "root").join(least, "root"), "components")
    out = info.select("id", "n", "c").join(named, "c", "left")
    return out.select(F.col("id").alias(key), "n", "c", "root", F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row of ``docs`` per component, that of the least id (of equal ids,
    the least class); rows with an empty set all stay. All columns are kept."""
    linked = link_components(docs, key, text, **settings)
    best = linked.filter("c is not null").groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("no"), F.col(key).alias("id"), F.col("c"))).alias("best"))
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    best = best.select(name(F.col("best.id")).alias("id"), F.col("best.c").alias("c"), F.lit(True).alias("hit"))
    width = settings.get("width", 5)

    def class_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher(width)
        for series in batches:
            out = np.full(len(series), -1, dtype=np.int64)
            for i, tokens in each_set(hasher, [(x or "").encode() for x in series]):
                out[i] = set_hash(tokens)
            yield pd.Series(out)

    rows = pack(docs, "r")
    rows = rows.select("r", F.pandas_udf(class_of, "bigint").asNondeterministic()(F.col("r")[text]).alias("c"), name(F.col("r")[key]).alias("id"))
    # rows with an empty set are no class: spread, each stays
    rows = rows.withColumn("c", F.when(F.col("c") >= 0, F.col("c")).otherwise(-1 - F.shiftrightunsigned(F.xxhash64("r"), 1)))
    joined = rows.join(best, ["c", "id"], "left")
    joined = joined.withColumn("k", F.row_number().over(Window.partitionBy("c", "id").orderBy("hit")))
    return joined.filter("c < 0 or (hit and k = 1)").select("r.*")
