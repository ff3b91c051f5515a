"""Chat formatting of reply trees, in DataFrame functions only.

Input: one row for each message with its tree, its own id, its parent's id (null:
a root), role, text and score.  Unary stretches of a tree are first contracted to
*chains* by pointer doubling (each row keeps its jump target and its distance, so
state is constant per message and a chain of n messages takes log2(n) self-joins).
The chains then form a tree whose depth is its number of branchings; iterative
self-joins extend each root's path by the child chains until no path has any.
A path is known by its leaf, so all paths are ranked by one running sum for each chain:
by the sum of their messages' scores (ties: the path of smaller leaf id).  Only the best
``best`` of each tree (None: all) are then walked back up to their root, and each is
formatted as one conversation.

Template of a turn: ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside a role or text
every ``<``, k tildes, ``|`` gets one more tilde, so no control string can occur in
it, and reading removes one: the escape is reversible.  A newline in a role is
written ``<n|``.  The loss mask holds (start, end) in code points of the formatted
conversation for each assistant text.

Cases: null role and text are empty, a null score is 0; a null tree is a tree like any
other; a message with a null id is one that nobody can answer; a parent that does not
exist makes its message a root; messages that only reach a cycle are dropped, as no root
leads to them; of equal (tree, id) rows the first by parent, role, text and score stays,
and its score counts; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.llm.common import stored

#: Control strings of the template (fixed values).
START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(x: Column) -> Column:
    return F.regexp_replace(x, r"<(~*)(n?)\|", r"<~$1$2|")


def unescaped(x: Column) -> Column:
    return F.regexp_replace(x, r"<~(~*)(n?)\|", r"<$1$2|")


def escaped_role(x: Column) -> Column:
    return F.replace(escaped(x), F.lit("\n"), F.lit("<n|"))


def unescaped_role(x: Column) -> Column:
    return unescaped(F.replace(x, F.lit("<n|"), F.lit("\n")))


def linear_replies(turns: DataFrame) -> DataFrame:
    """A plain conversation as a reply tree: each turn answers the one before it; rows without a turn come last."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


_NODES = ("tree", "node", "parent", "role", "text", "score")


def first_copies(nodes: DataFrame) -> DataFrame:
    """One row of each (tree, node), with keys that are never null: tree and node are wrapped in a struct."""
    order = F.struct(F.col("parent").isNotNull(), "parent", "role", "text", "score")
    one = nodes.select(*_NODES).groupBy("tree", "node").agg(F.min_by(F.struct("parent", "role", "text", "score"), order).alias("row"))
    key = lambda c: F.struct(F.col(c).alias("k"))
    parent = F.when(F.col("row.parent").isNotNull(), F.struct(F.col("row.parent").cast(nodes.schema["node"].dataType).alias("k")))
    return one.select(key("tree").alias("tree"), key("node").alias("node"), parent.alias("parent"), "row.role", "row.text", F.coalesce(F.col("row.score").cast("double"), F.lit(0.0)).alias("score"))


def chains(one: DataFrame) -> DataFrame:
    """``tree, node, parent, jump, distance, open`` : a first step of each node up its unary stretch."""
    links = one.select("tree", F.col("parent").alias("node")).filter("parent is not null").groupBy("tree", "node").agg(F.count(F.lit(1)).alias("children"))
    up = one.select("tree", "node", "parent").join(links.withColumnRenamed("node", "parent"), ["tree", "parent"], "left")
    exists = one.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    up = up.join(exists, ["tree", "parent"], "left")
    # A node whose parent has it as the only child continues the parent's chain; any other is a head.
    continues = F.coalesce(F.col("known") & (F.col("children") == 1), F.lit(False))
    return up.select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("parent"), F.when(continues, F.col("parent")).otherwise(F.col("node")).alias("jump"), F.when(continues, 1).otherwise(0).cast("long").alias("distance"), continues.alias("open"))


def _contracted(links: DataFrame) -> DataFrame:
    """Pointer doubling; a row whose target has reached its head is closed and not joined again.

    A jump that is open after r rounds spans 2^r messages: once that is more than there are, it goes round a cycle."""
    current = stored(links, "chains")
    rows = current.count()
    while True:
        ahead = current.select("tree", F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("distance").alias("more"), F.col("open").alias("still"))
        moved = current.filter("open").join(ahead, ["tree", "jump"]).select("tree", "node", "parent", F.col("next").alias("jump"), (F.col("distance") + F.col("more")).alias("distance"), F.col("still").alias("open"))
        state = moved.unionByName(current.filter("NOT open"))
        current = stored(state, "chains")
        far = current.filter("open").agg(F.max("distance").alias("far")).first().far
        if far is None or far > rows:
            return current.filter("NOT open").drop("open")


def _ranked(leaves: DataFrame, best: int | None) -> DataFrame:
    """Adds ``path``, from 1, to ``tree, head, over, score, leaf`` rows: by falling score, then leaf.

    Of all paths, no task holds a whole tree: rows are sorted by ranges, numbered inside each, and numbers go on from
    the ranges before, of which only counts are gathered for each tree."""
    order = [F.col("score").desc(), F.col("leaf")]
    if best is not None:  # a limit of rank, which Spark applies in each task before it shuffles
        return leaves.withColumn("path", F.row_number().over(W.partitionBy("tree").orderBy(*order)).cast("long")).filter(F.col("path") <= best)
    dealt = stored(leaves.repartitionByRange("tree", *order).withColumn("range", F.spark_partition_id()), "ranges")
    inside = dealt.withColumn("at", F.row_number().over(W.partitionBy("tree", "range").orderBy(*order)))
    before = W.partitionBy("tree").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy("tree", "range").count().select("tree", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    return inside.join(sizes, ["tree", "range"]).withColumn("path", F.col("at") + F.col("ahead")).drop("at", "ahead", "range")


def root_to_leaf(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """``tree, path, score, level, head, node, distance``: the messages of the chosen root-to-leaf paths, which are
    ranked from 1; ``level`` falls toward the leaf, ``distance`` grows. Tree, head and node are wrapped in a struct."""
    return _messages(stored(first_copies(nodes), "nodes"), best)


def _messages(one: DataFrame, best: int | None) -> DataFrame:
    members = _contracted(chains(one))
    heads = members.filter("distance = 0").select("tree", F.col("node").alias("head"), "parent")
    above = members.select("tree", F.col("node").alias("parent"), F.col("jump").alias("over"))
    tree = heads.join(above, ["tree", "parent"], "left").select("tree", "head", "over")
    scores = members.join(one.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", F.col("jump").alias("head")).agg(F.sum("score").alias("score"), F.max_by("node", "distance").alias("leaf"))
    tree = stored(tree.join(scores, ["tree", "head"]), "tree")
    inner = tree.filter("over is not null").select("tree", F.col("over").alias("head")).distinct().withColumn("inner", F.lit(True))
    below = tree.filter("over is not null").select("tree", F.col("over").alias("head"), F.col("head").alias("child"), F.col("score").alias("more"), F.col("leaf").alias("last"))
    front, done = tree.filter("over is null").select("tree", "head", "over", "score", "leaf"), None
    while True:  # downward: the sum of each chain's path
        front = stored(front.join(inner, ["tree", "head"], "left"), "front")
        ended = front.filter("inner is null").drop("inner")
        done = ended if done is None else done.unionByName(ended)
        front = front.filter("inner").drop("inner")
        if front.isEmpty():
            break
        front = front.join(below, ["tree", "head"]).select("tree", F.col("child").alias("head"), F.col("head").alias("over"), (F.col("score") + F.col("more")).alias("score"), F.col("last").alias("leaf"))
    front = stored(_ranked(done, best).select("tree", "path", "score", F.lit(0).alias("level"), "head", "over"), "paths")
    path, up = front, tree.select("tree", F.col("head").alias("over"), F.col("over").alias("next"))
    while not (front := front.filter("over is not null")).isEmpty():  # upward: the chains of the chosen paths
        front = stored(front.join(up, ["tree", "over"]).select("tree", "path", "score", (F.col("level") + 1).alias("level"), F.col("over").alias("head"), F.col("next").alias("over")), "paths")
        path = path.unionByName(front)
    return path.drop("over").join(members.select("tree", F.col("jump").alias("head"), "node", "distance"), ["tree", "head"])


def format_paths(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """``tree, path, score, formatted, loss``: one conversation for each chosen path."""
    one = stored(first_copies(nodes), "nodes")
    role, text = escaped_role(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    turn = one.select("tree", "node", (F.col("role") == "assistant").alias("loss"), role.alias("role"), text.alias("text"))
    rows = _messages(one, best).join(turn, ["tree", "node"])
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("level")).alias("level"), "distance", "role", "text", F.coalesce("loss", F.lit(False)).alias("loss"))))
    paths = rows.groupBy("tree", "path", "score").agg(ordered.alias("turns"))
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), t.role, F.lit("\n"), t.text, F.lit(END)).alias("piece"),
        (F.length(t.role) + len(START) + 1).alias("before"), F.length(t.text).alias("inside"), t.loss.alias("loss")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, p: Column) -> Column:
        start = state.at + p.before
        span = F.struct(start.alias("start"), (start + p.inside).alias("end"))
        return F.struct((start + p.inside + len(END)).alias("at"), F.when(p.loss, F.array_append(state.spans, span)).otherwise(state.spans).alias("spans"))

    made = paths.withColumn("pieces", pieces)
    return made.select("tree.k", "path", "score", F.array_join(F.col("pieces.piece"), "").alias("formatted"), F.aggregate("pieces", empty, add).spans.alias("loss")).withColumnRenamed("k", "tree")


def read_formatted(formatted: DataFrame) -> DataFrame:
    """``turns`` (role and text of each, unescaped) and ``loss_text`` out of formatted conversations."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.struct(
        unescaped_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescaped(F.substr(p, F.instr(p, F.lit("\n")) + 1, F.length(p) - F.instr(p, F.lit("\n")) - len(END))).alias("text")))
    loss = F.array_join(F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), s.start + 1, s.end - s.start))), "")
    return formatted.withColumns({"turns": turns, "loss_text": loss})
