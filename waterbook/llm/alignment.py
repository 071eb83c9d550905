"""Alignment of two tokenizers' tokens over the same bytes.

Tokenizer A (a byte-level BPE file) and B (a piece model) cut the same bytes
differently. Where a token of A and one of B end at the same offset, a group
ends; the tokens of a group are linked with each other.

Groups are found by skipping along diagonals: while token ``i`` of A and token
``i + shift`` of B end together, slices of the two length arrays are compared at
that shift, each twice as long as the last, so a one-to-one stretch costs a
few comparisons (after a common end, equal lengths are equal ends). A slice that differs is halved down to its first difference.
The irregular group that begins there is walked token by token until the ends
meet again, which gives the new shift.

Corpus counts: every block of documents names its distinct id pairs once, with
the number of its documents that hold them; Spark adds these up and gives each
block the counts of its own pairs back. No pair of token occurrences is ever a
row, and a pair that all documents hold is one row per block.

Defined results: a text that is null, empty, or whose bytes either tokenizer
changes (a null character is kept, U+2581 is not) has no tokens and zero
counts. Rows are independent: repeated rows and null keys are no special case
(a repeated row counts as a document of its own). Extra columns are ignored. A
very long text is a block of its own; a group in which the ends do not meet
for long costs its distinct ids, not its occurrences.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .bpe import byte_alphabet, read_spec
from .common import stored

#: Texts above this length go to the file's own library, which needs no stack
#: for long runs of white space; shorter ones to a faster one with equal ids.
LONG_TEXT = 200_000

#: Groups of more links than this are counted by their distinct ids.
WIDE_GROUP = 4096

#: Blocks, each some 0.6 MB, that a task reads at once.
BLOCKS_AT_ONCE = 8

#: How the byte-level files split a text before merging (a fixed value of their format).
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevelTokens:
    """Tokens of a byte-level BPE file; strings of special tokens are plain text."""

    def __init__(self, spec: str):
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        model = json.loads(spec)
        self.spec, self.library = spec, None
        byte = {c: i for i, c in enumerate(byte_alphabet())}
        special = {t["id"] for t in model.get("added_tokens") or []}
        vocab = model["model"]["vocab"]
        ranks = {bytes(byte[c] for c in s): i for s, i in vocab.items() if i not in special}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        made = [vocab[a + b] for a, b in merges]
        #: with all bytes in the vocabulary no text is changed
        self.whole = all(bytes([i]) in ranks for i in range(256))
        self.quick = None
        if made == sorted(made):  # the id is then the rank of its merge
            self.quick = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.quick is not None and len(text) <= LONG_TEXT:
            return self.quick.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
            self.library.encode_special_tokens = True
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.int64)


class PieceTokens:
    """Tokens of a piece model, which puts a space before the text itself."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        byte = re.compile("<0x([0-9A-F]{2})>")
        self.bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def group_runs(a: Sequence[int], b: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """The groups of two texts' token lengths with the same sum, as runs: the
    index after the first group's last token in ``a`` and in ``b``, and how
    many groups follow there, that one included, the others one to one."""
    ends_a: list[int] = []
    ends_b: list[int] = []
    lengths: list[int] = []
    i = j = 0
    n, m = len(a), len(b)
    while i < n:
        ahead = a[i] - b[j]  # bytes that A's tokens reach beyond B's
        # an irregular group, after which the shift is another one
        while ahead:
            if ahead < 0:
                i += 1
                ahead += a[i]
            else:
                j += 1
                ahead -= b[j]
        i += 1
        j += 1
        ends_a.append(i)
        ends_b.append(j)
        # a stretch at this shift: the first few one by one, then ever longer slices
        at, to, step = i, j, 8
        few = min(i + step, n)
        while at < few and a[at] == b[to]:
            at += 1
            to += 1
        if at == i + step:
            while at < n and a[at] == b[to]:
                step *= 2
                width = min(step, n - at, m - to)
                if a[at : at + width] == b[to : to + width]:
                    at += width
                    to += width
                    continue
                while width > 1:  # halve down to the first difference
                    half = width // 2
                    if a[at : at + half] == b[to : to + half]:
                        at += half
                        to += half
                        width -= half
                    else:
                        width = half
                break
        lengths.append(at - i + 1)
        i, j = at, to
    return ends_a, ends_b, lengths


def group_cuts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every group, the index after its last token in ``a`` and in ``b``,
    the tokens' lengths."""
    short = max(a.max(initial=0), b.max(initial=0)) < 256  # as bytes, which are quicker to compare
    runs = group_runs(*(x.astype(np.uint8).tobytes() if short else x.tolist() for x in (a, b)))
    first_a, first_b, lengths = (np.array(x, dtype=np.int64) for x in runs)
    at = np.cumsum(lengths) - lengths  # groups before each run
    place = np.arange(int(lengths.sum()))
    return place + np.repeat(first_a - at, lengths), place + np.repeat(first_b - at, lengths)


def group_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """``group_cuts`` of lists of rising end offsets with the same last one."""
    cut_a, cut_b = group_cuts(*(np.diff(np.array(x, dtype=np.int64), prepend=0) for x in (a, b)))
    return cut_a.tolist(), cut_b.tolist()


def sizes(ends: np.ndarray) -> np.ndarray:
    out = ends.copy()
    out[1:] -= ends[:-1]
    return out


def link_pairs(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs ``a << 32 | b`` of all links, ascending, and how many
    links each has."""
    size_a, size_b = sizes(ends_a), sizes(ends_b)
    wide = np.flatnonzero(size_a * size_b > WIDE_GROUP)
    repeat = np.repeat(np.where(size_a * size_b > WIDE_GROUP, 0, size_b) if len(wide) else size_b, size_a)
    first = np.repeat(ends_b - size_b, size_a)
    # every token of A meets `repeat` tokens of B from `first` on
    to = np.arange(int(repeat.sum())) + np.repeat(first - (np.cumsum(repeat) - repeat), repeat)
    keys, times = np.unique(np.repeat(a, repeat) << 32 | b[to], return_counts=True)
    if not len(wide):
        return keys, times
    found, counts = [keys], [times]
    for g in wide.tolist():
        x, nx = np.unique(a[ends_a[g] - size_a[g] : ends_a[g]], return_counts=True)
        y, ny = np.unique(b[ends_b[g] - size_b[g] : ends_b[g]], return_counts=True)
        found.append((x[:, None] << 32 | y[None, :]).ravel())
        counts.append((nx[:, None] * ny[None, :]).ravel())
    keys, back = np.unique(np.concatenate(found), return_inverse=True)
    times = np.zeros(len(keys), dtype=np.int64)
    np.add.at(times, back, np.concatenate(counts))
    return keys, times


class Aligner:
    """Both tokenizers' tables; aligns one text at a time."""

    def __init__(self, spec: str, proto: bytes):
        self.a, self.b = ByteLevelTokens(spec), PieceTokens(proto)
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (self.a, self.b))
        #: every id in decimal and a comma, after zero bytes: of one width, at least that of a number
        most = max(len(self.a.bytes), len(self.b.bytes))
        width = max(8, len(f"{most},"))
        self.names = np.array([f"{i},".rjust(width, "\0").encode() for i in range(most)], dtype=f"S{width}").view("u8" if width == 8 else f"V{width}")

    def align(self, text: str | None) -> tuple[np.ndarray, ...] | None:
        """Ids and end offsets of A, of B, and the groups' ends in both; none
        for a text without tokens."""
        if not text:
            return None
        spaced = " " + text
        data = spaced.encode()
        a, b = self.a.encode(spaced), self.b.encode(text)
        if b"".join(map(self.b.bytes.__getitem__, b)) != data:
            return None
        if not self.a.whole and b"".join(map(self.a.bytes.__getitem__, a.tolist())) != data:
            return None
        b = np.array(b, dtype=np.int64)
        size_a, size_b = self.size_a[a], self.size_b[b]
        return a, b, np.cumsum(size_a), np.cumsum(size_b), *group_cuts(size_a, size_b)

    def digest(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3``."""
        parts = np.empty(len(a) + len(b), dtype=self.names.dtype)
        # a group's tokens of A come before its tokens of B
        size_a, size_b = sizes(cut_a), sizes(cut_b)
        at_a = np.arange(len(a)) + np.repeat(cut_b - size_b, size_a)
        at_b = np.arange(len(b)) + np.repeat(cut_a, size_b)
        parts[at_a], parts[at_b] = self.names[a], self.names[b]
        text = parts.view(np.uint8).reshape(len(parts), -1)
        text[at_a[cut_a - 1], -1], text[at_b[cut_b - 1], -1] = ord("|"), ord(";")
        return hashlib.sha256(parts.tobytes().translate(None, b"\0")[:-1]).hexdigest()


def read_model(path: str) -> bytes:
    """The piece model's bytes, read on the driver and shipped with tasks."""
    with open(path, "rb") as f:
        return f.read()


def _block_type(key: StructField) -> StructType:
    long, ints = LongType(), ArrayType(IntegerType())
    doc = StructType(
        [StructField("key", key.dataType)]
        + [StructField(c, long) for c in ("n_a", "n_b", "n_groups", "n_links")]
        + [StructField("groups_sha256", StringType()), StructField("which", ints), StructField("times", ArrayType(long))]
    )
    return StructType([StructField("block", long), StructField("docs", ArrayType(doc)), StructField("pairs", ArrayType(long)), StructField("seen", ints)])


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)
    values = np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _block_batches(spec: str, proto: bytes, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = Aligner(spec, proto)
        block = TaskContext.get().partitionId() << 32
        nothing = np.empty(0, dtype=np.int64)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                done, size, counts, digests, pairs, times = at, 0, [], [], [], []
                while done < len(texts) and (size < most or done == at):
                    text = texts[done].as_py()
                    size += len(text or "")
                    done += 1
                    got = aligner.align(text)
                    if got is None:
                        counts.append((0, 0, 0, 0))
                        digests.append("")
                        pairs.append(nothing)
                        times.append(nothing)
                        continue
                    a, b, _, _, cut_a, cut_b = got
                    links = int(sizes(cut_a) @ sizes(cut_b))
                    counts.append((len(a), len(b), len(cut_a), links))
                    digests.append(aligner.digest(a, b, cut_a, cut_b))
                    found, n = link_pairs(a, b, cut_a, cut_b)
                    pairs.append(found)
                    times.append(n)
                own, back, seen = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
                which = np.split(back, np.cumsum([len(p) for p in pairs])[:-1])
                columns = [keys.slice(at, done - at), *(pa.array(c, pa.int64()) for c in zip(*counts, strict=True)), pa.array(digests, pa.string())]
                columns += [_lists(which, pa.int32()), _lists(times, pa.int64())]
                docs = pa.StructArray.from_arrays(columns, ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "which", "times"])
                row = [pa.array([block]), pa.ListArray.from_arrays(pa.array([0, done - at], pa.int32()), docs), _lists([own], pa.int64()), _lists([seen], pa.int32())]
                yield pa.RecordBatch.from_arrays(row, ["block", "docs", "pairs", "seen"])
                block += 1
                at = done

    return run


def align_blocks(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", block_chars: int = 400_000) -> DataFrame:
    """One row per block of about ``block_chars`` characters (or one longer
    text): its documents' counts, their distinct id pairs as places in
    ``pairs``, and how many of them hold each pair. Written to the shared
    folder, as everything else is derived from it; in small row groups, so
    that however many blocks a task has written, few are in memory at once."""
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    blocks = rows.mapInArrow(_block_batches(read_spec(path_a), read_model(path_b), block_chars), _block_type(rows.schema["k"]))
    return stored(blocks, "alignment", BLOCKS_AT_ONCE)


def link_table(blocks: DataFrame) -> DataFrame:
    """(a, b, n_documents, best) of every linked id pair of the corpus; best:
    no pair of the same ``a`` is held by more documents. The joined maxima
    have a row per id of A, so their size is bounded by its vocabulary."""
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "seen")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.seen").alias("n_documents"))
    pairs = stored(pairs.select("pair", F.shiftright("pair", 32).alias("a"), "n_documents"), "alignment-pairs")
    most = pairs.groupBy("a").agg(F.max("n_documents").alias("most"))
    joined = pairs.join(F.broadcast(most), "a")
    return joined.select("pair", "a", F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n_documents", (F.col("n_documents") == F.col("most")).alias("best"))


def document_links(blocks: DataFrame, links: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: key, counts, digest of its groups, ``n_best`` and
    ``count_sum``. A block asks once for each of its pairs."""
    asked = blocks.select("block", F.posexplode("pairs").alias("place", "pair"))
    found = asked.join(links.select("pair", "n_documents", "best"), "pair")
    answer = found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "n_documents", "best"))).alias("answer"))
    rows = blocks.select("block", "docs").join(answer, "block", "left")

    def totals(d):
        at = lambda w, t: F.struct(
            (F.get("answer", w)["n_documents"] * t).alias("sum"), F.when(F.get("answer", w)["best"], t).otherwise(0).alias("best")
        )
        add = lambda x, y: F.struct((x["sum"] + y["sum"]).alias("sum"), (x["best"] + y["best"]).alias("best"))
        zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("best"))
        return F.aggregate(F.zip_with(d["which"], d["times"], at), zero, add)

    kept = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    out = rows.select(F.inline(F.transform("docs", lambda d: F.struct(*[d[c].alias(c) for c in kept], totals(d).alias("totals")))))
    return out.select(F.col("key").alias(key), *kept[1:5], F.col("totals.best").alias("n_best"), F.col("totals.sum").alias("count_sum"), "groups_sha256")


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, corpus-wide best links and group digest of every document."""
    blocks = align_blocks(docs, path_a, path_b, key, text)
    return document_links(blocks, link_table(blocks), key)


def _group_batches(spec: str, proto: bytes, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(spec, proto)
        for batch in batches:
            for row in range(batch.num_rows):
                got = aligner.align(batch.column(1)[row].as_py())
                if got is None:
                    got = (np.empty(0, dtype=np.int64),) * 6
                a, b, end_a, _, cut_a, cut_b = got
                ends = end_a[cut_a - 1]
                ids = [_lists(np.split(x, cut[:-1]) if len(cut) else [], pa.int32()) for x, cut in ((a, cut_a), (b, cut_b))]
                groups = pa.StructArray.from_arrays([pa.array(np.append(0, ends[:-1])[: len(ends)], pa.int32()), pa.array(ends, pa.int32()), *ids], ["start", "end", "a", "b"])
                cell = pa.ListArray.from_arrays(pa.array([0, len(groups)], pa.int32()), groups)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), cell], [key, "groups"])

    return run


def groups(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, groups): byte span in space+text, ids of A and ids of B of every group."""
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("t"))
    ints = ArrayType(IntegerType())
    group = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("a", ints), StructField("b", ints)])
    kind = StructType([rows.schema[0], StructField("groups", ArrayType(group))])
    return rows.mapInArrow(_group_batches(read_spec(path_a), read_model(path_b), key), kind)
