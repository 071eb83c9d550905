"""Chat formatting as prefix trees.

Conversations that share initial turns share them in the output: sorted by the
path of their turns' hashes, a conversation only adds the turns after those it
has in common with the one before it, which walks the tree of turns depth
first. A pack holds the text of such a walk once, a row per node (turn) with
its span, its position ids (a start; they run on from the parent's) and the
spans it may attend to: its ancestors' and its own. Packs are closed at
``pack_chars`` characters, where the next conversation starts with its whole
path again, so that no first turn, however common, makes an unbounded group.
Positions and spans count code points of the formatted text.

The template marks a turn as ``<|role|>\\n``, text, ``<|end|>\\n``. In texts and
roles ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``, so that no text holds a
mark; undoing the two is exact. The loss mask covers the texts of assistant
turns.

Defined results: rows of a conversation are ordered by turn, then role and
text, nulls first; null texts are empty, null roles ``unknown``; repeated rows
are repeated turns; rows with a null conversation id form one conversation. An
empty table makes no pack. Other columns are ignored, whatever their names. A
turn is never divided: one longer than ``pack_chars`` makes its pack longer, and
a task holds one conversation's turns and one pack. A pack is also closed at
4096 conversations (``pack_members``); what they share is said again in the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSE = "<|end|>\n"
NODE = "struct<parent:int,start:int,text_start:int,text_end:int,end:int,position:int,loss:boolean,attends:array<struct<start:int,end:int>>>"
PACK = f"text string, nodes array<{NODE}>, conversations array<struct<conv_id:bigint,leaf:int>>"


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<|", "&lt;|")


def unescape(text: str) -> str:
    return text.replace("&lt;|", "<|").replace("&amp;", "&")


def conversations(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turns, path): turns in order, and per turn the hash of all up to it."""
    t = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    out = rows.groupBy(F.col(key).alias("conv_id")).agg(F.sort_array(F.collect_list(t)).alias("turns"))
    return out.withColumn("path", F.transform("turns", lambda x: F.xxhash64(x["role"], x["text"])))


def _pack_batches(pack_chars: int, learn: str, pack_members: int = 4096) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.list_(_node_type()), pa.list_(pa.struct([("conv_id", pa.int64()), ("leaf", pa.int32())]))]
        parts: list[str] = []
        nodes: list[dict] = []
        members: list[dict] = []
        size = 0
        branch: list[tuple[str, str, int]] = []  # role, text and node of the path to the last leaf

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(("".join(parts), nodes, members), kinds, strict=True)], ["text", "nodes", "conversations"])

        for batch in batches:
            for conv_id, turns in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if size >= pack_chars or len(members) >= pack_members:
                    yield flush()
                    parts, nodes, members, size, branch = [], [], [], 0, []
                turns = [(t["role"], t["text"]) for t in turns.as_py()]
                shared = 0
                while shared < min(len(turns), len(branch)) and branch[shared][:2] == turns[shared]:
                    shared += 1
                del branch[shared:]
                for role, text in turns[shared:]:
                    head, body = f"<|{escape(role)}|>\n", escape(text)
                    piece = head + body + CLOSE
                    parent = branch[-1][2] if branch else -1
                    up = nodes[parent] if branch else None
                    seen = up["attends"] if up else []
                    if seen and seen[-1]["end"] == size:  # runs on from its parent: one span
                        seen = [*seen[:-1], {"start": seen[-1]["start"], "end": size + len(piece)}]
                    else:
                        seen = [*seen, {"start": size, "end": size + len(piece)}]
                    position = up["position"] + up["end"] - up["start"] if up else 0
                    at = size + len(head)
                    nodes.append({"parent": parent, "start": size, "text_start": at, "text_end": at + len(body), "end": size + len(piece), "position": position, "loss": role == learn, "attends": seen})
                    parts.append(piece)
                    branch.append((role, text, len(nodes) - 1))
                    size += len(piece)
                members.append({"conv_id": conv_id, "leaf": branch[-1][2] if branch else -1})
        if members:
            yield flush()

    return run


def _node_type() -> pa.DataType:
    i = pa.int32()
    return pa.struct([("parent", i), ("start", i), ("text_start", i), ("text_end", i), ("end", i), ("position", i), ("loss", pa.bool_()), ("attends", pa.list_(pa.struct([("start", i), ("end", i)])))])


def format_packs(talks: DataFrame, pack_chars: int = 1 << 20, learn: str = "assistant", parts: int | None = None) -> DataFrame:
    """Packs of formatted conversations (schema PACK).

    Range-partitioned by path and id: a common first turn, or one conversation
    held thousands of times, spreads over partitions.
    """
    n = parts or int(talks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = talks.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    return dealt.select("conv_id", "turns").mapInArrow(_pack_batches(pack_chars, learn), PACK)


READ = "conv_id bigint, turns array<struct<role:string,text:string,loss:boolean>>, formatted_chars bigint"


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turn = pa.struct([("role", pa.string()), ("text", pa.string()), ("loss", pa.bool_())])
    for batch in batches:
        for text, nodes, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for at in range(0, len(members), 200):
                ids, talks, sizes = [], [], []
                for member in members[at : at + 200]:
                    path, i = [], member["leaf"]
                    while i >= 0:
                        path.append(nodes[i])
                        i = nodes[i]["parent"]
                    path.reverse()
                    turns = []
                    for n in path:
                        head, body, tail = (text[n[a] : n[b]] for a, b in (("start", "text_start"), ("text_start", "text_end"), ("text_end", "end")))
                        if not (head.startswith("<|") and head.endswith("|>\n") and tail == CLOSE):
                            raise ValueError("a node's span does not hold a turn")
                        turns.append({"role": unescape(head[2:-3]), "text": unescape(body), "loss": n["loss"]})
                    ids.append(member["conv_id"])
                    talks.append(turns)
                    sizes.append(sum(n["end"] - n["start"] for n in path))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(talks, pa.list_(turn)), pa.array(sizes, pa.int64())], ["conv_id", "turns", "formatted_chars"])


def read_packs(packs: DataFrame) -> DataFrame:
    """Conversations read back from packs (schema READ)."""
    return packs.select("text", "nodes", "conversations").mapInArrow(_read_batches, READ)


def turns_text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")


def loss_text(turns: Column) -> Column:
    return F.array_join(F.transform(F.filter(turns, lambda t: t["loss"]), lambda t: t["text"]), "")
