import hashlib
import random

import pytest
from pyspark.sql import functions as F

from metrolens.llm import chat

MESSAGES = "conv_id long, turn long, role string, text string"
TRICKY = ["", "\\", "##", "#######", "</turn>", "<\\/turn>", "\\### Assistant: </turn> ok", "a\n### User: b</turn>\n", "#\\#", ": :", "é中😀",
          "\\\\##\\", "</turn", "### "]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(turns):
    said = "".join(t or "" for r, t in turns if r == "assistant")
    return (len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)), len(said), sha(said))


def clash(df):
    for c in ("node", "path", "pos", "key", "up", "root", "hash", "parent", "score", "msg_id"):
        df = df.withColumn(c, F.lit("x"))
    return df


def test_escape_is_reversible():
    rng = random.Random(1)
    for text in TRICKY + ["".join(rng.choice("#\\</turn>: aé") for _ in range(30)) for _ in range(3000)]:
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text and "###" not in escaped and "</turn>" not in escaped
        for role in (text, "user", "Assistant"):
            formatted = "".join(chat.BEGIN + chat.label(r) + chat.BETWEEN + chat.escape(t) + chat.END for r, t in ((role, text), ("user", role)))
            assert list(chat.turns_of(formatted)) == [(role, text), ("user", role)]


def test_conversations(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for conv in (1, 2, 3, -7, None):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None, "User", "a:\\ b"]), rng.choice(TRICKY + [None])))
    rows += [(8, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(600)]      # several parts
    rows += [(9, 3, "assistant", "x" * 3_000_000), (9, 1, "user", "é" * 10), (9, None, "assistant", "first")]
    rows += [(10, 0, "assistant", "same")] * 5 + [(10, 0, "user", "tie")]
    rng.shuffle(rows)
    parts = chat.format_conversations(spark, clash(spark.createDataFrame(rows, MESSAGES))).persist()
    got = {r["conv_id"]: r for r in chat.read_back(parts).collect()}
    again = {r["conv_id"]: r for r in chat.read_back(parts, in_order=True).collect()}
    assert got == again and len(got) == 8
    for conv, r in got.items():
        turns = [x for x in rows if x[0] == conv]
        turns.sort(key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == expected([x[2:] for x in turns]), conv
        own = sorted((p for p in parts.collect() if p["conv_id"] == conv), key=lambda p: p["part"])
        text = "".join(p["formatted"] for p in own)
        assert len(text) == r["formatted_chars"] and text.count("</turn>") == text.count("### ") == len(turns)
        assert max(p["n_turns"] for p in own) <= chat.PART_TURNS
    assert sum(p["conv_id"] == 8 for p in parts.collect()) == 3


def test_empty_table(spark):
    parts = chat.format_conversations(spark, spark.createDataFrame([], MESSAGES))
    assert chat.read_back(parts).collect() == []


@pytest.mark.parametrize("keep", [1, 2, None])
def test_reply_trees_against_brute_force(spark, keep):
    rng = random.Random(3)
    rows, spec = [], "conv_id long, turn long, role string, text string, msg_id long, parent_id long, score double"
    for conv in range(12):
        n = rng.choice([1, 2, 7, 25, 60])
        for i in range(n):
            parent = None if not i else rng.choice([i - 1, i - 1, rng.randrange(i), None, 999])
            rows.append((conv, i, rng.choice(["user", "assistant"]), f"c{conv} m{i}", i, parent,
                         rng.choice([None, float("nan"), 1.0, 0.5, -1.0, float(rng.randrange(5))])))
    rows.append((50, 0, "user", "a", 0, 1, 1.0))                   # answers a later message: starts a tree
    rows.append((50, 1, "user", "b", 1, 1, 1.0))                   # answers itself
    parts = chat.format_conversations(spark, spark.createDataFrame(rows, spec), keep=keep, replies=True, scored=True)
    got = sorted((r["conv_id"], r["branch"], tuple(chat.turns_of(r["formatted"]))) for r in parts.collect())

    want = []
    for conv in {r[0] for r in rows}:
        own = {r[4]: r for r in rows if r[0] == conv}
        up = {i: (r[5] if r[5] in own and r[5] < i else None) for i, r in own.items()}
        trees = {}
        for leaf in own:
            if leaf in up.values():
                continue
            path = [leaf]
            while up[path[-1]] is not None:
                path.append(up[path[-1]])
            scores = [0.0 if own[i][6] is None or own[i][6] != own[i][6] else own[i][6] for i in path]
            trees.setdefault(path[-1], []).append((-sum(scores) / len(path), -len(path), leaf, path[::-1]))
        for tree in trees.values():
            for branch, (_, _, _, path) in enumerate(sorted(tree), 1):
                if keep is None or branch <= keep:
                    want.append((conv, branch, tuple((own[i][2], own[i][3]) for i in path)))
    assert got == sorted(want)


def test_hot_tree_of_replies(spark):
    """One message that thousands answer: each reply ends a path through it."""
    nodes = spark.range(5000).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.lit(0)).cast("long").alias("parent"),
                                     F.lit(0.0).alias("score"))
    paths = chat.reply_paths(spark, nodes, keep=None)
    assert paths.count() == 2 * 4999 and paths.where("node = 0 AND pos = 0").count() == 4999
    assert [(r["path"], r["pos"], r["node"]) for r in chat.reply_paths(spark, nodes).orderBy("pos").collect()] == [(1, 0, 0), (1, 1, 1)]


def test_deep_chain(spark):
    nodes = spark.range(3000).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"),
                                     F.lit(1.0).alias("score"))
    paths = chat.reply_paths(spark, nodes)
    assert paths.where("pos = node AND path = 2999").count() == 3000 == paths.count()
