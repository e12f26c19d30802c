"""Chat formatting of reply trees (operator 11).

Messages that answer each other form trees. Iterative self-joins of the reply
links (each doubles the distance it looks up) give every message its root, its
depth and the score of its branch; the leaves of a tree are ranked by the mean
score of their branch (ties: the longer branch, then the earlier leaf), and the
``keep`` best root-to-leaf paths are listed by joins over the same links.
Each chosen path becomes one conversation:

    ### User: text</turn>
    ### Assistant: text</turn>

Inside texts ``\\`` becomes ``\\\\``, ``##`` becomes ``#\\#`` and ``</turn>``
becomes ``<\\/turn>``, so no text holds a control string, and dropping each
backslash that is not itself escaped gives the text back. The loss mask is a
list of spans (code points of the formatted text) that cover the assistants'
texts.

A conversation is written in parts of at most ``PART_TURNS`` turns and about
``PART_CHARS`` characters (one part, if it is no longer than that). Rows reach
the formatter sorted and one by one, so a conversation of any length needs the
memory of one part; only its own order keeps it in one task.

Messages: ``conv_id``, ``turn``, ``role``, ``text``; other columns are ignored,
but for ``msg_id`` and ``parent_id`` when ``replies`` is set and ``score`` when
``scored`` is. Without ``replies`` a message answers the one before it in its
conversation. Messages are in order of turn (null first); ties are in order of
role, then of a hash of the text. A message without parent, or whose parent is
missing or not earlier than itself, begins a tree. Null roles and texts are
empty; rows without ``conv_id`` form one conversation; repeated rows are turns
of their own, and the reply to one of several messages of one id answers the
first. A null or NaN score counts 0. An empty table gives no conversation.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metrolens.llm.common import slices, stored

PART_TURNS = 256
PART_CHARS = 1 << 20
LOSS_ROLE = "assistant"
# Fixed values of the template.
LABELS = {"system": "System", "user": "User", "assistant": "Assistant"}
BEGIN, BETWEEN, END = "### ", ": ", "</turn>\n"
ESCAPES = [("\\", "\\\\"), ("##", "#\\#"), ("</turn>", "<\\/turn>")]

_PARTS = "path long, branch int, part int, n_turns int, formatted string, loss_spans array<struct<start: int, end: int>>"
_DIGESTS = "path long, branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    for a, b in ESCAPES:
        text = text.replace(a, b)
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def label(role: str) -> str:
    """A known role by its title; any other as it is, marked where it equals a title."""
    if role in LABELS:
        return LABELS[role]
    return ("\\" if role in LABELS.values() else "") + escape(role).replace(":", "\\:")


def role_of(label_text: str) -> str:
    for role, title in LABELS.items():
        if label_text == title:
            return role
    return unescape(label_text)


def turns_of(formatted: str):
    """(role, text) of each turn of a formatted part."""
    for turn in formatted.split(END)[:-1]:
        head = _HEAD.match(turn)
        yield role_of(head[1]), unescape(turn[head.end():])


# --- reply trees


def numbered_messages(spark: SparkSession, messages: DataFrame, replies: bool = False, scored: bool = False) -> DataFrame:
    """(node, conv_id, key, parent, score): the distinct messages of
    each conversation numbered in order, without their texts; ``parent`` is the
    node that is answered, null at the start of a tree."""
    keys = ["conv_id", "key"]
    extra = {"msg_id": F.first("msg_id"), "parent_id": F.first("parent_id")} if replies else {}
    score = F.first(F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0))) if scored else F.lit(0.0)
    ids = messages.groupBy(*keys).agg(score.alias("score"), *[c.alias(n) for n, c in extra.items()])
    # ranges of about equal size: a conversation of any length spans several
    ranged = ids.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(spark, ranged.select("*", F.spark_partition_id().alias("_range"),
                                         F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")), "messages")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")) \
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # one row per range: bounded by the number of partitions
    nodes = placed.join(F.broadcast(starts), "_range").withColumn("node", F.col("_start") + F.col("_at"))
    if replies:
        named = nodes.where("msg_id IS NOT NULL").groupBy(F.struct("conv_id", "msg_id").alias("answers")).agg(F.min("node").alias("parent"))
        nodes = nodes.withColumn("answers", F.struct("conv_id", F.col("parent_id").alias("msg_id")))
        linked = nodes.join(stored(spark, named, "message-ids"), "answers", "left")
        parent = F.when(F.col("parent") < F.col("node"), F.col("parent"))
    else:
        earlier = nodes.select((F.col("node") + 1).alias("node"), F.col("conv_id").alias("_conv"), F.lit(True).alias("_after"))
        linked = nodes.join(earlier, "node", "left")
        parent = F.when(F.col("_conv").eqNullSafe(F.col("conv_id")) & F.col("_after"), F.col("node") - 1)
    return stored(spark, linked.select("node", "conv_id", "key", parent.alias("parent"), "score"), "nodes")


def reply_paths(spark: SparkSession, nodes: DataFrame, keep: int | None = 1) -> DataFrame:
    """(path, branch, pos, node): the ``keep`` best root-to-leaf paths of every
    tree (None: all). ``path`` is the leaf's node, ``branch`` its rank in the
    tree from 1, ``pos`` the depth of ``node``. ``nodes``: (node, parent, score);
    a parent has a smaller number than those that answer it."""
    done = nodes.where("parent IS NULL").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"),
                                                F.col("score").alias("total"))
    active = nodes.where("parent IS NOT NULL").select("node", F.col("parent").alias("up"), F.col("score").alias("total"))
    hops = []                              # hops[k]: (node, up) with up 2^k replies above node
    while not active.isEmpty():
        hops.append(active.select("node", "up"))
        none = F.lit(None).cast("long")
        targets = active.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("above"),
                                none.alias("root"), none.alias("depth")).unionByName(
            done.select(F.col("node").alias("up"), none.alias("next"), F.col("total").alias("above"), "root", "depth"))
        met = stored(spark, active.join(targets, "up").select(
            "node", F.col("next").alias("up"), (F.col("total") + F.col("above")).alias("total"), "root",
            (F.col("depth") + (1 << (len(hops) - 1))).alias("depth")), "reply-hops")
        done = done.unionByName(met.where("root IS NOT NULL").select("node", "root", "depth", "total"))
        active = met.where("up IS NOT NULL").select("node", "up", "total")
    answered = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
    leaves = done.join(answered, "node", "left_anti")
    order = Window.partitionBy("root").orderBy((F.col("total") / (F.col("depth") + 1)).desc(), F.col("depth").desc(), "node")
    leaves = leaves.withColumn("branch", F.row_number().over(order))
    if keep is not None:
        leaves = leaves.where(F.col("branch") <= keep)
    paths = stored(spark, leaves.select(F.col("node").alias("path"), "branch", F.col("depth").alias("pos"), "node"), "leaves")
    for k in reversed(range(len(hops))):
        above = F.when(F.col("up").isNotNull(), F.struct((F.col("pos") - (1 << k)).alias("pos"), F.col("up").alias("node")))
        both = F.filter(F.array(F.struct("pos", "node"), above), lambda x: x.isNotNull())
        paths = paths.join(hops[k], "node", "left").select("path", "branch", F.explode(both).alias("m")) \
            .select("path", "branch", "m.pos", "m.node")
        if k and k % 4 == 0:
            paths = stored(spark, paths, "reply-paths")
    return paths


# --- formatting


def _keyed(messages: DataFrame, replies: bool, scored: bool) -> DataFrame:
    """Messages with the key that orders and names them within a conversation."""
    cols = ["conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")]
    cols += [F.col(c) for c in (("msg_id", "parent_id") if replies else ())] + ([F.col("score")] if scored else [])
    rows = messages.select(*cols)
    key: list[Column] = [F.col("turn"), F.col("role"), F.xxhash64("text").alias("hash")]
    key += [F.col(c) for c in (("msg_id", "parent_id") if replies else ())]
    if scored:
        key.append(F.col("score"))
    return rows.withColumn("key", F.struct(*key))


def _format(batches):
    """mapInArrow step: sorted turns -> parts of formatted conversations."""
    names, current, part, chars, pieces, spans, rows = None, None, 0, 0, [], [], []

    def close():
        nonlocal part, chars, pieces, spans
        if pieces:
            rows.append((*current, part, len(pieces), "".join(pieces), spans))
            part, chars, pieces, spans = part + 1, 0, [], []

    def out():
        columns = list(zip(*rows))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, names)], schema=names)

    size = 0
    for batch in batches:
        if names is None:
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            names = pa.schema([batch.schema.field("conv_id"), ("path", pa.int64()), ("branch", pa.int32()), ("part", pa.int32()),
                               ("n_turns", pa.int32()), ("formatted", pa.string()), ("loss_spans", span)])
        for piece in slices([batch]):
            columns = [piece.column(c).to_pylist() for c in ("conv_id", "path", "branch", "role", "text")]
            for conv, path, branch, role, text in zip(*columns):
                if current is None or current[1] != path:
                    close()
                    current, part = (conv, path, branch), 0
                elif len(pieces) >= PART_TURNS or chars >= PART_CHARS:
                    close()
                head, body = BEGIN + label(role) + BETWEEN, escape(text)
                if role == LOSS_ROLE:
                    spans.append({"start": chars + len(head), "end": chars + len(head) + len(body)})
                pieces.append(head + body + END)
                chars += len(pieces[-1])
                size += len(pieces[-1])
            if rows and size > PART_CHARS:
                size = 0
                yield out()
    close()
    if rows:
        yield out()


def format_conversations(spark: SparkSession, messages: DataFrame, keep: int | None = 1, replies: bool = False,
                         scored: bool = False) -> DataFrame:
    """Formatted conversations: (conv_id, path, branch, part, n_turns, formatted,
    loss_spans), the parts of a path together and in order within a partition."""
    rows = _keyed(messages, replies, scored)
    nodes = numbered_messages(spark, rows, replies, scored)
    paths = reply_paths(spark, nodes, keep)
    # written, so that its size is known before the texts are joined to it
    placed = stored(spark, paths.join(nodes.select("node", F.struct("conv_id", "key").alias("key")), "node").drop("node"), "turns")
    texts = rows.select(F.struct("conv_id", "key").alias("key"), "text")
    turns = placed.join(texts, "key").select(F.col("key.conv_id").alias("conv_id"), "path", "branch", "pos",
                                             F.col("key.key.role").alias("role"), "text")
    conv = messages.schema["conv_id"].dataType.simpleString()
    return (turns.repartition("path").sortWithinPartitions("path", "pos", "text").drop("pos")
            .mapInArrow(_format, f"conv_id {conv}, {_PARTS}"))


def _read_back(batches):
    """mapInArrow step: parts in order -> what a path's turns and mask say."""
    names, current, state, rows = None, None, None, []

    def close():
        if current is not None:
            turns, loss, n, loss_chars, chars = state
            rows.append((*current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

    def out():
        columns = list(zip(*rows))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, names)], schema=names)

    for batch in batches:
        if names is None:
            names = pa.schema([batch.schema.field("conv_id"), ("path", pa.int64()), ("branch", pa.int32()), ("n_turns", pa.int64()),
                               ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                               ("formatted_chars", pa.int64())])
        for piece in slices([batch], "formatted"):
            columns = [piece.column(c).to_pylist() for c in ("conv_id", "path", "branch", "formatted", "loss_spans")]
            for conv, path, branch, formatted, spans in zip(*columns):
                if current is None or current[1] != path:
                    close()
                    current, state = (conv, path, branch), [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                for role, text in turns_of(formatted):
                    state[0].update(f"{role}\n{text}\n".encode())
                    state[2] += 1
                for s in spans:
                    said = unescape(formatted[s["start"]:s["end"]])
                    state[1].update(said.encode())
                    state[3] += len(said)
                state[4] += len(formatted)
        if rows:
            yield out()
    close()
    if rows:
        yield out()


def read_back(parts: DataFrame, in_order: bool = False) -> DataFrame:
    """One row per path: its turns, and the text under its loss mask, as the
    formatted parts give them. ``in_order``: each path's parts already stand
    together and in order, as ``format_conversations`` returns them."""
    if not in_order:
        parts = parts.repartition("path").sortWithinPartitions("path", "part")
    conv = parts.schema["conv_id"].dataType.simpleString()
    return parts.mapInArrow(_read_back, f"conv_id {conv}, {_DIGESTS}")
