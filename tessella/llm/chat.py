"""Chat formatting of reply trees, in DataFrame operations only.

Messages form trees by their parents. Iterative self-joins double the distance that
a message looks up its tree, so paths of n messages take log2(n) rounds; that gives
depths and path scores. The best leaves of each tree are chosen by score, the same
tables lead from them back to the root, and each chosen path becomes one
conversation.

A turn is written <|role|>text<|end|>. Inside roles and texts the characters that
could begin a control string of this or another common template are escaped (see
ESCAPES), so texts can't forge turns and come back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# Fixed values of the format: what is escaped, and how.
ESCAPES = (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"), ("|", "\\p"))
END = "<|end|>"


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    def part(x: Column) -> Column:
        for raw, safe in ESCAPES[1:]:
            x = F.replace(x, F.lit(safe), F.lit(raw))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def jumps(nodes: DataFrame) -> list[DataFrame]:
    """nodes: tree, node, parent, score. The k-th table has for each node its ancestor 2**k
    levels up (null above the root), and over the nodes up to there their number and
    total score. The last table has no ancestors, but for nodes below a circle."""
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    first = nodes.join(known, ["tree", "parent"], "left")
    out = [materialize(first.select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("steps"), F.col("score").cast("double").alias("score")))]
    while not out[-1].filter("up is not null").isEmpty():
        if len(out) > 1 and 1 << (len(out) - 1) > 2 * out[0].count():
            break
        a = out[-1]
        b = a.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("score").alias("score2"))
        # Only nodes that are still on their way up are joined; roots are known to all.
        moved = a.filter("up is not null").join(b, ["tree", "up"], "left").select("tree", "node", F.col("up2").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score"))
        out.append(materialize(a.filter("up is null").unionByName(moved)))
    return out


def best_paths(nodes: DataFrame, top: int) -> DataFrame:
    """tree, path (1 for the best), node and depth of each node on the `top` root-to-leaf
    paths with the highest total score in each tree; ties go to the smaller leaf."""
    tables = jumps(nodes)
    end = tables[-1].filter("up is null")
    leaf = end.join(tables[0].select("tree", F.col("up").alias("node")).filter("node is not null"), ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.col("score").desc(), "node")
    path = leaf.withColumn("path", F.row_number().over(order)).filter(F.col("path") <= top).select("tree", "path", "node", F.lit(0).cast("long").alias("back"))
    for k in range(len(tables) - 2, -1, -1):
        up = tables[k].filter("up is not null").select("tree", "node", "up")
        path = materialize(path.unionByName(path.join(up, ["tree", "node"]).select("tree", "path", F.col("up").alias("node"), (F.col("back") + F.lit(1 << k)).alias("back"))))
    return path.join(end.select("tree", "node", "steps"), ["tree", "node"]).select("tree", "path", "node", F.col("steps").alias("depth"))


def format_replies(messages: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", score: str | None = None, top: int = 1, train: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per chosen path: tree, path (its rank), n_turns, formatted, and segments:
    the pieces of formatted in order, with loss = true for texts of the roles in
    train. A null or unknown parent makes a root; null texts and roles count as empty,
    null scores as 0; a null tree is a tree of its own; of rows that repeat tree and
    node the smallest stays; messages in or below a circle of parents are on no path;
    other columns are left out; no rows for no messages."""
    key = F.when(F.col(tree).isNull(), F.lit("n")).otherwise(F.concat(F.lit("t"), F.col(tree).cast("string")))
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    rows = messages.filter(F.col(node).isNotNull()).select(key.alias("tree"), F.col(tree).alias("of"), F.col(node).alias("node"), F.col(parent).alias("parent"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), value.alias("score"))
    kept = rows.groupBy("tree", "node").agg(F.min(F.struct("of", "parent", "role", "text", "score")).alias("m")).select("tree", "node", "m.*")
    path = best_paths(kept.select("tree", "node", "parent", "score"), top)
    turns = path.join(kept.select("tree", "node", "of", "role", "text"), ["tree", "node"])
    ordered = turns.groupBy("tree", "path").agg(F.first("of").alias("of"), F.array_sort(F.collect_list(F.struct("depth", "node", "role", "text"))).alias("turns"))

    def pieces(t: Column) -> Column:
        piece = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
        return F.array(piece(F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>")), F.lit(False)), piece(escape(t["text"]), t["role"].isin(*train)), piece(F.lit(END), F.lit(False)))

    out = ordered.select(F.col("of").alias("tree"), "path", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", pieces)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns in a formatted conversation."""
    turn = F.slice(F.split(formatted, r"<\|end\|>", -1), 1, F.size(F.split(formatted, r"<\|end\|>", -1)) - 1)
    return F.transform(turn, lambda x: F.struct(unescape(F.regexp_extract(x, r"(?s)\A<\|([^|]*)\|>", 1)).alias("role"), unescape(F.regexp_replace(x, r"(?s)\A<\|[^|]*\|>", "")).alias("text")))


def loss_text(formatted: Column, segments: Column) -> Column:
    """The texts under the loss mask, unescaped, read back from formatted: of segments only
    the marks count, and of these the one in the middle of each turn."""
    marks = F.transform(F.filter(segments, lambda s, i: i % 3 == 1), lambda s: s["loss"])
    return F.array_join(F.zip_with(read_back(formatted), marks, lambda t, m: F.when(m, t["text"])), "")


def chained(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as reply trees: each turn replies to the one before. Ties of
    turn are ordered by role and text."""
    order = Window.partitionBy(conv).orderBy(*(F.col(c).asc_nulls_first() for c in (turn, role, text)))
    return turns.select(F.col(conv).alias("tree"), F.row_number().over(order).cast("long").alias("node"), F.col(role).alias("role"), F.col(text).alias("text")).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
