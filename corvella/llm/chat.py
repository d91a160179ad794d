"""Chat formatting: reply trees to conversations, in DataFrame operations only.

Nodes of reply trees are (conv_id, node_id, parent_id, role, text, score). Pointers to ancestors are doubled
by self-joins (distance 1, 2, 4, ...), which gives each node its depth and the sum of scores from its root in
log2(depth) rounds. Leaves are ranked within their tree by the mean score of their branch, then depth, then
the smaller node_id. The jump tables, used once more, list the nodes of each chosen root-to-leaf path,
and each path becomes one conversation.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline, for each turn. Inside roles and texts a
backslash is doubled and a backslash is put behind the first character of each control string; in roles also
before each newline. ``unescape`` drops one backslash before any character and so restores every text.

Loss mask: ``loss`` lists (start, len) in code points of the formatted string, one for each assistant text.

Cases: null role or text is empty; null turns come first; equal (conv_id, turn) rows follow each other by role,
then text; a null conv_id is a conversation of its own; a parent that is not in the table makes its
node a root; of rows that share a tree and a node_id the smallest counts, and a null node_id is left out; nodes on a cycle have no root and are left out; extra columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvella.llm.common import shared_root

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common chat templates, as a pattern behind their first character.
_CONTROL = r"<(?=\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({_CONTROL})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def nodes_of_turns(turns: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: each turn answers the one before."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("conv_id", F.row_number().over(w).cast("long").alias("node_id"), "role", "text")
    return rows.withColumn("parent_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1)).withColumn("score", F.lit(0.0))


def one_row_each(nodes: DataFrame) -> DataFrame:
    """Nodes with an id, once each: of rows that share a tree and an id the smallest by parent, role, text and score."""
    row = F.struct("parent_id", "role", "text", F.col("score").cast("double").alias("score"))
    return nodes.where("node_id is not null").groupBy("conv_id", "node_id").agg(F.min(row).alias("row")).select("conv_id", "node_id", "row.*")


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, leaf, branch_rank, node_id, depth) of the ``branches`` best root-to-leaf paths of each tree; ids are unique."""
    shared_root(nodes.sparkSession)
    edges = nodes.select("conv_id", "node_id", "parent_id", F.coalesce("score", F.lit(0.0)).cast("double").alias("total"))
    known = edges.select(F.col("conv_id"), F.col("node_id").alias("jump"))
    state = edges.alias("e").join(known.alias("k"), _same("e", "k") & (F.col("e.parent_id") == F.col("k.jump")), "left")
    state = state.select("e.conv_id", "e.node_id", "k.jump", "e.total", F.lit(1).cast("long").alias("depth")).checkpoint()
    levels, left = [], -1
    while (now := state.where("jump is not null").count()) and now != left:
        left = now
        levels.append(state.where("jump is not null").select("conv_id", "node_id", "jump"))
        # only nodes that have not met their root yet take part
        s, o = state.where("jump is not null").alias("s"), state.alias("o")
        moved = s.join(o, _same("s", "o") & (F.col("s.jump") == F.col("o.node_id"))).select("s.conv_id", "s.node_id", "o.jump", (F.col("s.total") + F.col("o.total")).alias("total"), (F.col("s.depth") + F.col("o.depth")).alias("depth"))
        state = state.where("jump is null").union(moved).checkpoint()
    rooted = state.where("jump is null").select("conv_id", "node_id", "total", "depth")
    parents = edges.where("parent_id is not null").select("conv_id", "parent_id").distinct()
    leaves = rooted.alias("r").join(parents.alias("p"), _same("r", "p") & (F.col("r.node_id") == F.col("p.parent_id")), "left_anti")
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node_id"))
    chosen = leaves.withColumn("branch_rank", rank).where(F.col("branch_rank") <= branches)
    paths = chosen.select("conv_id", F.col("node_id").alias("leaf"), "branch_rank", "node_id", "depth")
    for k, level in enumerate(levels):
        p, j = paths.alias("p"), level.alias("j")
        up = p.join(j, _same("p", "j") & (F.col("p.node_id") == F.col("j.node_id"))).select("p.conv_id", "leaf", "branch_rank", F.col("j.jump").alias("node_id"), (F.col("depth") - 2**k).alias("depth"))
        paths = paths.union(up).checkpoint()  # else the plan doubles with each level
    return paths


def format_trees(nodes: DataFrame, branches: int = 1, unique: bool = False) -> DataFrame:
    """(conv_id, leaf, branch_rank, n_turns, formatted, loss) for each chosen path. ``unique``: no two nodes of a tree share an
    id, as after ``nodes_of_turns``, which saves a shuffle."""
    nodes = nodes if unique else one_row_each(nodes)
    paths = best_paths(nodes, branches)
    p, n = paths.alias("p"), nodes.select("conv_id", "node_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("n")
    turns = p.join(n, _same("p", "n") & (F.col("p.node_id") == F.col("n.node_id"))).select("p.conv_id", "leaf", "branch_rank", "depth", "role", "text")
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    turns = turns.select("conv_id", "leaf", "branch_rank", "depth", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    w = W.partitionBy("conv_id", "leaf").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    turns = turns.withColumn("start", F.sum(F.length("piece").cast("long")).over(w) - F.length("piece") + F.length("head"))
    turns = turns.select("conv_id", "leaf", "branch_rank", F.struct("depth", "piece", (F.col("role") == "assistant").alias("loss"), "start", F.length("body").alias("len")).alias("t"))
    out = turns.groupBy("conv_id", "leaf", "branch_rank").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    spans = F.transform(F.filter("ts", lambda t: t.loss), lambda t: F.struct(t.start.alias("start"), t.len.cast("long").alias("len")))
    return out.select("conv_id", "leaf", "branch_rank", F.size("ts").cast("long").alias("n_turns"), F.array_join(F.col("ts.piece"), "").alias("formatted"), spans.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, as they were before formatting."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")

    def turn(piece):
        rest = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        role = F.regexp_extract(rest, r"(?s)^((?:[^\\\n]|\\.)*)\n", 1)
        text = F.substring(rest, F.length(role) + 2, F.length(rest))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s.start.cast("int") + 1, s.len.cast("int")))), "")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").union(extra)
    out = format_trees(nodes_of_turns(turns), unique=True)
    out = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss")).alias("masked"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"), F.sha2(F.col("masked"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'),
    '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|</?s>|<</?SYS>>|\[/?INST\]', '\0+', 'g') AS body FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(body) + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
