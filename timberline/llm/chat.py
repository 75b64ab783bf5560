"""Chat formatting of reply trees.

Messages point at their parents. Iterative self-joins with pointer doubling enumerate every root-to-leaf path in
log2(depth) rounds, each written to the shared folder; branches are ranked by their score, and each chosen path
becomes one conversation. The template marks turns with control strings; control strings inside a text or role get
a backslash put between their first two characters, which is undone on reading, so any text survives.

A path is one string in the end, so one conversation must fit into one task; nothing larger is gathered. Defined
cases: null text or role is empty; messages with a null tree (conv_id) are one tree; a parent that does not exist makes a root; replies in a cycle, and what leads to one, are cut off; ties of
turn follow role, then text; repeated rows are turns of their own; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, materialize, sha_hex

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turns(turns: list[tuple[str, str]], loss_roles: tuple[str, ...] = ("assistant",)) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (start, end) of code points under the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role_out(role)}\n", escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; ValueError if it isn't one."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((_role_in(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return out


def _keyed(nodes: DataFrame) -> DataFrame:
    """nodes with a tree that joins find even where it is null."""
    return nodes.withColumn("tree", F.struct(F.col("tree").isNull().alias("none"), F.coalesce("tree", F.lit(0)).cast("long").alias("id")))


def _plain(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tree", F.when(~F.col("tree.none"), F.col("tree.id")))


def paths(nodes: DataFrame) -> DataFrame:
    """nodes (tree, node, parent) -> (tree, leaf, node, dist): each leaf's path to its root, the leaf at distance 0.

    Rows of two kinds share one join a round: hops (start, its 2^k-th ancestor) and places on paths (leaf, ancestor).
    A parent that is no node ends up on a path, too; a join with the nodes drops it. Nodes with a null tree are one tree.
    """
    return _plain(_paths(_keyed(nodes)))


def _paths(nodes: DataFrame) -> DataFrame:
    nodes = nodes.select("tree", "node", "parent")
    up = nodes.where("parent is not null")
    own = nodes.select("tree", "node", F.lit(1).alias("own"), F.lit(0).alias("child"))
    marks = own.union(up.select("tree", F.col("parent").alias("node"), F.lit(0), F.lit(1)))
    leaves = marks.groupBy("tree", "node").agg(F.max("own").alias("own"), F.max("child").alias("child")).where("own = 1 and child = 0")
    hops = up.select("tree", F.col("node").alias("start"), F.col("parent").alias("at"), F.lit(1).cast("long").alias("dist"), F.lit(False).alias("path"))
    state = materialize(hops.union(leaves.select("tree", F.col("node").alias("start"), "node", F.lit(0).cast("long"), F.lit(True))), "chat-paths")
    reach, counted = 1, []

    def size() -> int:
        """Nodes of the largest tree; asked for only after some rounds."""
        if not counted:
            counted.append(nodes.groupBy("tree").count().agg(F.max("count")).first()[0] if reach > 1024 else 1 << 40)
        return counted.pop() if counted[0] == 1 << 40 else counted[0]

    while True:
        hops = state.where("not path")
        if hops.isEmpty():
            break
        if reach > size():  # what still hops is on a cycle, or leads to one
            state = state.join(hops.select("tree", F.col("start").alias("at")).distinct(), ["tree", "at"], "left_anti").select("tree", "start", "at", "dist", "path")
            break
        on = hops.select("tree", F.col("start").alias("at"), F.col("at").alias("next"), F.col("dist").alias("more"))
        further = state.join(on, ["tree", "at"]).select("tree", "start", F.col("next").alias("at"), (F.col("dist") + F.col("more")).alias("dist"), "path")
        state, reach = materialize(state.where("path").union(further), "chat-paths"), 2 * reach
    return state.select("tree", F.col("start").alias("leaf"), F.col("at").alias("node"), "dist")


def format_trees(nodes: DataFrame, branches: int | None = None, loss_roles: tuple[str, ...] = ("assistant",), read_back: bool = False) -> DataFrame:
    """nodes (tree, node, parent, score, role, text) -> tree, leaf, rank, score, formatted, spans.

    A branch scores the mean of its nodes' scores (null: 0); branches: how many of each tree to keep, best first,
    ties to the smaller leaf; None keeps all. Nodes with a null tree are one tree. read_back: instead, what reading each formatted conversation gives (see READ).
    """
    nodes = _keyed(nodes).select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), "role", "text")
    nodes = materialize(nodes, "chat-nodes")
    on_path = _paths(nodes).join(nodes.select("tree", "node", "score", "role", "text"), ["tree", "node"])
    branch = on_path.repartition("tree").groupBy("tree", "leaf").agg(
        F.avg("score").alias("score"),
        F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"),
    )
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    branch = branch.withColumn("rank", rank)
    if branches is not None:
        branch = branch.where(F.col("rank") <= branches)
    schema = pa.schema(
        [("tree", pa.int64()), ("leaf", pa.int64()), ("rank", pa.int32()), ("score", pa.float64()), ("formatted", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))]
    )

    def make(c: dict) -> dict:
        done = [format_turns([(t["role"], t["text"]) for t in turns], loss_roles) for turns in c.pop("turns")]
        return {k: c[k] for k in ("tree", "leaf", "rank", "score")} | {"formatted": [d[0] for d in done], "spans": [[list(s) for s in d[1]] for d in done]}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = batches(it, schema, make)
        return batches(out, READ_ARROW, _read) if read_back else out

    rows = _plain(branch).select("tree", "leaf", "rank", "score", "turns")
    return rows.mapInArrow(run, READ if read_back else "tree long, leaf long, rank int, score double, formatted string, spans array<array<long>>")


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
READ_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def _read(c: dict) -> dict:
    turns = [parse_turns(f) for f in c["formatted"]]
    loss = ["".join(unescape(f[a:b]) for a, b in spans) for f, spans in zip(c["formatted"], c["spans"], strict=True)]
    return {
        "conv_id": c["tree"],
        "n_turns": [len(t) for t in turns],
        "turns_sha256": [sha_hex("".join(f"{r}\n{x}\n" for r, x in t).encode()) for t in turns],
        "loss_chars": [len(x) for x in loss],
        "loss_sha256": [sha_hex(x.encode()) for x in loss],
        "formatted_chars": [len(f) for f in c["formatted"]],
    }


def from_conversations(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as trees without branches: each row replies to the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.withColumn("node", F.row_number().over(order).cast("long")).select(
        F.col("conv_id").alias("tree"), "node", (F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text"
    )
