"""Chat formatting of reply trees, with DataFrame operations only.

Messages form trees by a parent column. Root-to-leaf paths come from iterative self-joins that double their reach: jump
tables hold each message's ancestor 1, 2, 4, ... steps up, and the paths of all leaves grow by one table a round, so a path
of n messages takes log2(n) rounds. Branches of a tree are ranked by score, and each chosen path is formatted as one conversation:

    <|turn|>ROLE<|text|>TEXT<|end|>⏎

Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so no control string can stand there; taking each
backslash away and keeping the character after it reads them back. The loss mask lists the text spans of LOSS_ROLE.

Edge cases: null texts and roles are empty; null tree ids form one tree; a parent that is missing makes its message a root;
messages on or below a cycle have no root and no path; a repeated message id counts once, with the smallest role, text and
score; an empty table gives an empty result; other columns are ignored. One path becomes one row, so one task holds it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

# Fixed values of the template.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) for ``messages(tree, node, parent)`` of keys without nulls: every message of every path, ``up`` steps above the leaf."""
    own = messages.select("tree", "node", "parent")
    known = own.select("tree", F.col("node").alias("parent"))
    jump = checkpoint(own.where("parent is not null").join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("above")))
    leaves = own.select("tree", "node").join(jump.select("tree", F.col("above").alias("node")), ["tree", "node"], "left_anti")
    jumps, size = [], own.count()
    while not jump.isEmpty():
        if 1 << len(jumps) > size:  # longer than any path without a cycle
            leaves = leaves.join(jump.select("tree", "node"), ["tree", "node"], "left_anti")
            break
        jumps.append(jump)
        further = jump.select("tree", F.col("node").alias("above"), F.col("above").alias("top"))
        jump = checkpoint(jump.join(further, ["tree", "above"]).select("tree", "node", F.col("top").alias("above")))
    reached = checkpoint(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    for k, jump in enumerate(jumps):
        more = reached.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        reached = reached.unionAll(checkpoint(more))
    return reached


def conversations(messages: DataFrame, tree_col: str, id_col: str, parent_col: str, role_col: str, text_col: str, score_col: str | None = None, top: int | None = None, loss_role: str = LOSS_ROLE) -> DataFrame:
    """A row a chosen path: tree, leaf, rank, score, n_turns, formatted, loss_spans (code points, end exclusive).

    A branch's score is the mean of its messages' scores (0 where null or without a score column); ties go to the smaller
    leaf. ``top`` keeps that many branches of each tree, None all of them.
    """
    tree, node = F.col(tree_col), F.col(id_col)
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    key = lambda c: F.concat(F.when(c.isNull(), "-").otherwise("="), F.coalesce(c.cast("string"), F.lit("")))
    rows = messages.select(key(tree).alias("tree"), key(node).alias("node"), F.struct(tree.alias("tree_id"), node.alias("node_id"), F.when(F.col(parent_col).isNotNull(), key(F.col(parent_col))).alias("parent"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), score.alias("score")).alias("m"))
    rows = checkpoint(rows.groupBy("tree", "node").agg(F.min("m").alias("m")).select("tree", "node", "m.*"))
    piece = rows.select("tree", "node", "tree_id", "node_id", "score", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == loss_role).alias("loss"))
    reached = paths(rows)
    if top is not None:  # branches are ranked and cut by scores and ids alone, before any text joins them
        scored = reached.join(rows.select("tree", "node", "score", "node_id"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("score"), F.min(F.when(F.col("up") == 0, F.col("node_id"))).alias("leaf_id"))
        place = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf_id"))
        reached = reached.join(checkpoint(scored.withColumn("place", place).where(F.col("place") <= top).select("tree", "leaf")), ["tree", "leaf"])
    along = reached.join(piece, ["tree", "node"])
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    fixed = len(TURN) + len(TEXT) + len(END)
    size = F.length("role") + F.length("text") + fixed
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + len(TURN) + F.length("role") + len(TEXT)
    turn = F.struct((-F.col("up")).alias("at"), F.concat(F.lit(TURN), "role", F.lit(TEXT), "text", F.lit(END)).alias("piece"), "loss", start.alias("start"), (start + F.length("text")).alias("end"))
    whole = along.select("tree", "leaf", "tree_id", "node_id", "up", "score", turn.alias("turn")).groupBy("tree", "leaf").agg(F.first("tree_id").alias("tree_id"), F.min(F.when(F.col("up") == 0, F.col("node_id"))).alias("leaf_id"), F.avg("score").alias("score"), F.array_sort(F.collect_list("turn")).alias("turns"))
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf_id")
    if top is not None or score_col:
        whole = whole.withColumn("rank", F.row_number().over(best))
    else:
        whole = whole.withColumn("rank", F.lit(None).cast("int"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return whole.select(F.col("tree_id").alias("tree"), F.col("leaf_id").alias("leaf"), "rank", "score", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: str = "formatted") -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    turns = F.split(F.col(formatted), r"<\|end\|>\n", -1)
    turns = F.slice(turns, 1, F.size(turns) - 1)

    def turn(t: Column) -> Column:
        parts = F.split(F.substring(t, len(TURN) + 1, 1 << 30), r"<\|text\|>", -1)
        return F.struct(unescape(parts[0]).alias("role"), unescape(parts[1]).alias("text"))

    return F.transform(turns, turn)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))]
    own = own.unionAll(spark.range(1).select(F.inline(F.array(*extra))))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    linear = own.withColumn("at", at.cast("long")).withColumn("parent", F.when(F.col("at") > 1, F.col("at") - 1))
    done = conversations(linear, "conv_id", "at", "parent", "role", "text")
    done = done.select(F.col("tree").alias("conv_id"), "formatted", "loss_spans", read_back().alias("turns"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    done = done.withColumn("loss", loss)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(turns).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
  SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS n FROM m
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
