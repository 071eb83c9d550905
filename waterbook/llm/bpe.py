"""BPE encoding and decoding with a public vocabulary file.

``Encoder`` merges each pre-token with a priority queue of merge ranks over a
doubly linked list of symbols, skipping entries that an earlier merge has made
stale, so a pre-token of n symbols costs n log n however long it is. Pre-tokens
of up to ``SHORT`` bytes look for the least rank in a list instead, which is
the same order and less work for so few. Results of short pre-tokens are
remembered in a bounded table. Decoding concatenates the
vocabulary's strings with the file's separator; without a decoder in the file
that is one blank between tokens.

Defined results: a null text is encoded as the empty text (no ids, decoded to
the empty text). Rows are independent: repeated rows and null ids are no
special case. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens above this length are not remembered; beyond about this many
#: bytes the table of remembered ones starts anew.
MEMO_LENGTH, MEMO_BYTES = 48, 48_000_000

#: Bytes of a pre-token merged without a queue, at most; more than any rank.
SHORT, NO_RANK = 32, 1 << 62

#: Unicode white space as the normalizer of these files reads ``\s``.
WHITE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level files."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


class Encoder:
    """A byte-level BPE file as id and merge tables."""

    def __init__(self, spec: dict):
        import regex

        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("only byte-level BPE files are read")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        ids = self.ids
        #: rank by pair of ids, and the id that the merge of a rank makes
        self.ranks = {ids[a] << 20 | ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        alphabet = byte_alphabet()
        self.first = [ids.get(c) for c in alphabet]
        self.last = [ids.get(c + self.suffix) for c in alphabet]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        names = sorted(self.special, key=len, reverse=True)
        self.find_special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.split = None
        for p in pre.get("pretokenizers") or [pre]:
            if p["type"] == "Split":
                pattern = p["pattern"].get("Regex") or regex.escape(p["pattern"]["String"])
                self.split = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^" + WHITE[1:-1] + r"\p{L}\p{N}]"))
            elif p["type"] == "ByteLevel" and p.get("use_regex", True):
                self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        kinds = spec.get("normalizer") or {}
        kinds = kinds.get("normalizers") or ([kinds] if kinds else [])
        self.steps = [k["type"] if k["type"] != "Replace" else "Space" for k in kinds]
        if {*self.steps} - {"NFC", "Space", "Lowercase"}:
            raise ValueError(f"normalizers {self.steps} are not read")
        self.space = regex.compile(WHITE + "+")
        if self.split and not self.split.search(" \t\n\x85\xa0\u2028\u3000"):
            self.steps = [s for s in self.steps if s != "Space"]  # pre-tokens hold no white space
        self.known: dict[str, bytes] = {}
        self.held = 0
        size = max([*ids.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for table in (ids, self.special):
            for text, i in table.items():
                self.strings[i] = text
        self.separator = " " if spec.get("decoder") is None else ""

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        data = word.encode()
        if not data:
            return []
        symbols = [self.first[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        if None in symbols:
            symbols = [s for s in symbols if s is not None]
        n = len(symbols)
        if n <= SHORT:
            return self._merge_short(symbols)
        rank_of, made = self.ranks.get, self.made
        # a queue entry is rank << 32 | position; no pair with -1 has a rank
        queue = [r << 32 | i for i in range(n - 1) if (r := rank_of(symbols[i] << 20 | symbols[i + 1])) is not None]
        if not queue:
            return symbols
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        symbols.append(-1)
        before, after = list(range(-1, n)), list(range(1, n + 2))
        while queue:
            entry = pop(queue)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j, left = after[i], symbols[i]
            if left < 0 or j >= n or rank_of(left << 20 | symbols[j]) != rank:
                continue  # stale: one of the two symbols has been merged away
            symbols[i], symbols[j] = new, _ = made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(new << 20 | symbols[k])) is not None:
                    push(queue, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank_of(symbols[h] << 20 | new)) is not None:
                push(queue, r << 32 | h)
        return [x for x in symbols if x >= 0]

    def _merge_short(self, symbols: list[int]) -> list[int]:
        """Merges the leftmost pair of the least rank until none has one."""
        rank_of, made = self.ranks.get, self.made
        ranks = [rank_of(a << 20 | b, NO_RANK) for a, b in zip(symbols, symbols[1:])]
        while ranks and (rank := min(ranks)) < NO_RANK:
            i = ranks.index(rank)
            symbols[i] = new = made[rank]
            del symbols[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(new << 20 | symbols[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank_of(symbols[i - 1] << 20 | new, NO_RANK)
        return symbols

    def normalize(self, text: str) -> str:
        for step in self.steps:
            if step == "NFC":
                text = text if text.isascii() else unicodedata.normalize("NFC", text)
            elif step == "Space":
                text = self.space.sub(" ", text)
            else:  # per character, so no final sigma
                text = text.lower() if text.isascii() else text.replace("Σ", "σ").lower()
        return text

    def pretokens(self, text: str) -> list[str]:
        return self.split.findall(self.normalize(text)) if self.split else [self.normalize(text)]

    def packed(self, word: str) -> bytes:
        """Ids of one pre-token as 32-bit numbers in the machine's order."""
        got = self.known.get(word)
        if got is None:
            got = array("i", self.merge(word)).tobytes()
            if len(word) <= MEMO_LENGTH:
                self.held += 190 + 2 * len(word) + len(got)
                if self.held > MEMO_BYTES:
                    self.known.clear()
                    self.held = 0
                self.known[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed; strings of special tokens are those tokens."""
        if self.find_special is None or not self.find_special.search(text):
            return self.encode_plain(text)
        out, at = [], 0
        for m in self.find_special.finditer(text):
            out += [self.encode_plain(text[at : m.start()]), array("i", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self.encode_plain(text[at:])])

    def encode_plain(self, text: str) -> bytes:
        known = self.known
        words = self.pretokens(text)
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            return b"".join([known.get(w) or self.packed(w) for w in words])


def read_spec(path: str) -> str:
    """The vocabulary file's text, read on the driver and shipped with tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _encode_batches(spec: str, key: str, most: int, back: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        coder = Encoder(json.loads(spec))
        strings = pa.array(coder.strings, pa.string())
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(texts):
                done, size, parts = at, 0, []
                while done < len(texts) and (size < most or done == at):  # a bounded piece of the batch
                    text = texts[done].as_py() or ""
                    parts.append(coder.encode(text))
                    size += len(text)
                    done += 1
                ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int64)
                flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                columns = [keys.slice(at, done - at), ids]
                yield pa.RecordBatch.from_arrays([*columns, *([_strings_of(ids, strings, coder.separator)] if back else [])], [key, "ids", *(["decoded"] if back else [])])
                at = done

    return run


def _strings_of(ids: pa.ListArray, strings: pa.Array, separator: str) -> pa.Array:
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(ids), 0)).to_pylist()
    lists = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), strings.take(ids.flatten()))
    return pc.binary_join(lists, separator)


def _encoded(docs: DataFrame, path: str, key: str, text: str, piece: int, back: bool) -> DataFrame:
    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(_encode_batches(read_spec(path), key, piece, back), f"`{key}` {kind}, ids array<int>{', decoded string' if back else ''}")


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", piece: int = 1_000_000) -> DataFrame:
    """(key, ids array<int>) of every whole text. Tasks hold one batch of rows
    and the ids of about ``piece`` characters (or of one text)."""
    return _encoded(docs, path, key, text, piece, back=False)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", piece: int = 1_000_000) -> DataFrame:
    """(key, ids, decoded): the texts encoded and their ids decoded again, as
    ``decode(encode(..))`` gives, in one pass with one set of tables a task."""
    return _encoded(docs, path, key, text, piece, back=True)


def _decode_batches(spec: str, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(json.loads(spec))
        strings = pa.array(coder.strings, pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _strings_of(part.column(1), strings, coder.separator)], [key, "ids", "decoded"])

    return run


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded) of (key, ids)."""
    rows = encoded.select(key, "ids")
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(_decode_batches(read_spec(path), key), f"`{key}` {kind}, ids array<int>, decoded string")


def with_digests(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(key, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
