"""Token counts kept up to date under edits.

A document is cut into pieces where white space follows anything else; no
pre-token, special string or normalisation step of a byte-level BPE file
reaches across such a place, so a text's token count is the sum of its pieces'
counts. The pieces are the leaves of a segment tree that holds characters and
tokens of every subtree. An edit descends by characters to the leaves that it
touches, re-encodes only those, with a neighbour where the edit reaches a
leaf's end, and updates the sums on the way to the root.

Trees can be kept: ``build_trees`` gives a table of pieces with their counts,
``edit_trees`` takes it with edits and gives the counts and the trees as they
are then, encoding nothing but what the edits touch.

Defined results: a null text is empty. Positions and lengths outside the text
are cut to it; null ones count as 0, a null insertion is empty. Edits of one
id run by ``seq`` (nulls first), then by their other columns; they apply to
every row of that id. Rows with a null id have no edits; edits of unknown ids
give nothing. Extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WHITE, Encoder, read_spec

#: Characters of a piece, at least, and pieces of a leaf, at most.
PIECE, LEAF = 200, 16


class CountTree:
    """Text, token count and segment tree of one document."""

    def __init__(self, text: str, coder: Encoder):
        import regex

        self.cuts = regex.compile(f"(?<=[^{WHITE[1:]})(?={WHITE})")
        self.coder = coder
        self.encoded = 0
        self.build([[p] for p in self.pieces(text)])

    @classmethod
    def kept(cls, pieces: list[str], tokens: list[int], coder: Encoder) -> CountTree:
        """The tree of stored pieces; sums only, nothing is encoded."""
        tree = cls("", coder)
        tree.build([[p] for p in zip(pieces, tokens, strict=True)])
        return tree

    def pieces(self, text: str) -> list[tuple[str, int]]:
        """Encoded pieces of a text that starts and ends at safe places."""
        out, at = [], 0
        while at < len(text):
            cut = self.cuts.search(text, at + PIECE)
            end = cut.start() if cut else len(text)
            out.append((text[at:end], len(self.coder.encode(text[at:end])) // 4))
            at = end
        self.encoded += len(text)
        return out

    def build(self, leaves: list[list[tuple[str, int]]]) -> None:
        self.leaves = leaves or [[]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, leaf in enumerate(self.leaves):
            self.chars[self.size + i] = sum(len(t) for t, _ in leaf)
            self.tokens[self.size + i] = sum(n for _, n in leaf)
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(t for leaf in self.leaves for t, _ in leaf)

    def find(self, position: int) -> tuple[int, int]:
        """Leaf that holds a position, and the position where the leaf starts;
        the end of the text lies in the last leaf that is not empty."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if position >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def replace_leaf(self, i: int, leaf: list[tuple[str, int]]) -> None:
        self.leaves[i] = leaf
        i += self.size
        self.chars[i], self.tokens[i] = sum(len(t) for t, _ in leaf), sum(n for _, n in leaf)
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def edit(self, position: int, deleted: int, inserted: str) -> int:
        """Replace ``deleted`` characters at ``position``; returns how many
        characters were encoded again."""
        position = min(max(position, 0), self.n_chars)
        end = min(position + max(deleted, 0), self.n_chars)
        before = self.encoded
        first, start = self.find(position)
        if position == start and position > 0:  # may join the end of the leaf before
            first, start = self.find(position - 1)
        last, _ = self.find(end)  # an edit up to a leaf's end takes in the next leaf
        old = "".join(t for leaf in self.leaves[first : last + 1] for t, _ in leaf)
        new = old[: position - start] + inserted + old[end - start :]
        fresh = self.pieces(new)
        slots = last - first + 1
        share = -(-len(fresh) // slots)
        for i in range(slots):
            self.replace_leaf(first + i, fresh[i * share : (i + 1) * share])
        if share > LEAF:  # leaves grew: cut them anew, nothing is encoded
            self.build([[p] for leaf in self.leaves for p in leaf])
        return self.encoded - before


def _edit_batches(spec: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by id, a document's row before its edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(json.loads(spec))
        current, trees = None, []
        for batch in batches:
            out = []
            for key, kind, seq, position, deleted, text in zip(*batch.columns, strict=True):
                key, seq = key.as_py(), seq.as_py()
                if key is None or key != current:
                    current, trees = key, []
                if kind.as_py() == 0:
                    tree = CountTree(text.as_py() or "", coder)
                    out.append((key, None, tree.n_chars, tree.n_tokens, tree.encoded))
                    if key is not None:
                        trees.append(tree)
                    continue
                for tree in trees if key is not None else ():
                    done = tree.edit(position.as_py() or 0, deleted.as_py() or 0, text.as_py() or "")
                    out.append((key, seq, tree.n_chars, tree.n_tokens, done))
            if out:
                names = ["k", "seq", "n_chars", "n_tokens", "encoded_chars"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [batch.schema.field(0).type, *[pa.int64()] * 4], strict=True)], names)

    return run


def count_edits(docs: DataFrame, edits: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every document before (``seq`` null) and after each of its
    edits (key, seq, position, deleted, inserted): key, seq, n_chars, n_tokens
    and encoded_chars, the characters that were encoded for it.

    Documents and edits meet by one shuffle on the id, sorted; a task streams
    them and holds the trees of one id at a time, however many edits follow.
    """
    empty = F.lit(None).cast("long")
    rows = docs.select(F.col(key).alias("k"), F.lit(0).alias("kind"), empty.alias("seq"), empty.alias("position"), empty.alias("deleted"), F.col(text).alias("t"))
    more = edits.select(F.col(key).alias("k"), F.lit(1).alias("kind"), F.col("seq").cast("long"), F.col("position").cast("long"), F.col("deleted").cast("long"), F.col("inserted").alias("t"))
    spread = F.when(F.col("k").isNull(), F.xxhash64("t"))  # rows without an id are not one group
    both = rows.union(more).repartition(F.col("k"), spread).sortWithinPartitions("k", "kind", "seq", "position", "deleted", "t")
    kind = rows.schema["k"].dataType.simpleString()
    out = both.mapInArrow(_edit_batches(read_spec(path)), f"k {kind}, seq bigint, n_chars bigint, n_tokens bigint, encoded_chars bigint")
    return out.withColumnRenamed("k", key)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


TREE = [("pieces", pa.list_(pa.string())), ("tokens", pa.list_(pa.int32()))]
COUNTS = [(c, pa.int64()) for c in ("seq", "n_chars", "n_tokens", "encoded_chars")]


def _tree_batches(spec: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(json.loads(spec))
        for batch in batches:
            pieces = [CountTree("", coder).pieces(t.as_py() or "") for t in batch.column(1)]
            if pieces:
                rows = [(k.as_py(), [t for t, _ in p], [n for _, n in p]) for k, p in zip(batch.column(0), pieces, strict=True)]
                yield _columns(rows, pa.schema([("k", batch.schema.field(0).type), *TREE]))

    return run


def build_trees(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pieces, tokens) of every document, to be stored: the leaves of its
    tree in order, each with its token count. No shuffle. The text is the
    pieces one after another, the document's count the sum of ``tokens``."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    out = rows.mapInArrow(_tree_batches(read_spec(path)), f"k {kind}, pieces array<string>, tokens array<int>")
    return out.withColumnRenamed("k", key)


def _kept_batches(spec: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by id, a document's tree before its edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(json.loads(spec))
        current, trees, schema = None, [], None

        def finished() -> list[tuple]:
            flat = ([p for leaf in tree.leaves for p in leaf] for tree in trees)
            return [(current, None, t.n_chars, t.n_tokens, t.encoded, [p for p, _ in f], [n for _, n in f]) for t, f in zip(trees, flat, strict=True)]

        for batch in batches:
            schema = pa.schema([("k", batch.schema.field(0).type), *COUNTS, *TREE])
            out = []
            for key, kind, seq, position, deleted, text, pieces, tokens in zip(*batch.columns, strict=True):
                key = key.as_py()
                if key is None or key != current:
                    out += finished()
                    current, trees = key, []
                if kind.as_py() == 0:
                    trees.append(CountTree.kept(pieces.as_py() or [], tokens.as_py() or [], coder))
                    continue
                for tree in trees if key is not None else ():
                    done = tree.edit(position.as_py() or 0, deleted.as_py() or 0, text.as_py() or "")
                    out.append((key, seq.as_py(), tree.n_chars, tree.n_tokens, done, None, None))
            if out:
                yield _columns(out, schema)
        if trees:
            yield _columns(finished(), schema)

    return run


def edit_trees(trees: DataFrame, edits: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Edits (key, seq, position, deleted, inserted) on stored trees. A row
    without ``pieces`` gives the counts after one edit, as ``count_edits`` does;
    a row with ``pieces`` is a document's tree after all of them (``seq`` null,
    ``encoded_chars`` of all its edits). To be written once: ``kept_trees`` of
    it are the trees of the next call, also of documents without edits. One
    shuffle on the id; a task holds the trees of one id at a time.
    """
    empty = F.lit(None).cast("long")
    none = [F.lit(None).cast("array<string>").alias("pieces"), F.lit(None).cast("array<int>").alias("tokens")]
    rows = trees.select(F.col(key).alias("k"), F.lit(0).alias("kind"), empty.alias("seq"), empty.alias("position"), empty.alias("deleted"), F.lit(None).cast("string").alias("t"), "pieces", "tokens")
    more = edits.select(F.col(key).alias("k"), F.lit(1).alias("kind"), F.col("seq").cast("long"), F.col("position").cast("long"), F.col("deleted").cast("long"), F.col("inserted").alias("t"), *none)
    spread = F.when(F.col("k").isNull(), F.xxhash64("t", "pieces"))  # rows without an id are not one group
    both = rows.union(more).repartition(F.col("k"), spread).sortWithinPartitions("k", "kind", "seq", "position", "deleted", "t")
    kind = rows.schema["k"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c, _ in COUNTS)
    out = both.mapInArrow(_kept_batches(read_spec(path)), f"k {kind}, {counts}, pieces array<string>, tokens array<int>")
    return out.withColumnRenamed("k", key)


def kept_trees(edited: DataFrame, key: str = "doc_id") -> DataFrame:
    """The trees in a stored result of ``edit_trees``, for the next edits."""
    return edited.filter(F.col("pieces").isNotNull()).select(key, "pieces", "tokens")


def sample_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Three edits of every document, from its own text: a replacement, a
    deletion and an insertion, at places given by hashes of the id."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    at = lambda salt: F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.greatest(n, F.lit(1)).cast("long"))
    one = F.struct(F.lit(1).alias("seq"), at(1).alias("position"), F.lit(60).cast("long").alias("deleted"), F.substring(t, 1, 45).alias("inserted"))
    two = F.struct(F.lit(2).alias("seq"), at(2).alias("position"), F.lit(25).cast("long").alias("deleted"), F.lit("").alias("inserted"))
    three = F.struct(F.lit(3).alias("seq"), at(3).alias("position"), F.lit(0).cast("long").alias("deleted"), F.concat(F.lit(" "), F.substring(t, -30, 30), F.lit("'s 42%")).alias("inserted"))
    return docs.select(F.col(key), F.explode(F.array(one, two, three)).alias("e")).select(key, "e.*")
