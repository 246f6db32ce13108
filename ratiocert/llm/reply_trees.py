"""Reply trees as conversations: paths by self-joins, branches ranked by score, one text per chosen path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """Control strings all start with ``<|``; after this none is left, and ``unescape`` gives the text back."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    """As ``escape``; also without line ends, since one ends the role in the header."""
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def _chains(nodes: DataFrame) -> DataFrame:
    """Adds ``chain`` (first node of the unbranched run that a node is in) and ``dist`` (its place there).

    Pointer doubling: after r self-joins every run of up to 2^r messages is resolved, so a conversation of a
    thousand turns takes ten.
    """
    children = nodes.where("parent IS NOT NULL").groupBy("tree", "parent").agg(F.count("*").alias("n_children"))
    above = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    linked = nodes.join(above, ["tree", "parent"], "left").join(children, ["tree", "parent"], "left")
    head = F.col("known").isNull() | (F.col("n_children") > 1)
    columns = ["tree", "node", "parent", "score", "chain", "dist"]
    open_ones = cut_lineage(linked.select(
        "tree", "node", F.when(F.col("known"), F.col("parent")).alias("parent"), "score",
        F.when(head, F.col("node")).otherwise(F.col("parent")).alias("chain"),
        F.when(head, 0).otherwise(1).cast("long").alias("dist"),
    ))
    done, reach, total = open_ones.where(F.col("dist") < 1), 1, open_ones.count()
    open_ones = open_ones.where(F.col("dist") >= 1)
    while reach <= total and open_ones.limit(1).count():
        # Only messages whose first one isn't known yet move on; after each round those are at least twice as far from it.
        known = done.union(open_ones)
        up = known.select("tree", F.col("node").alias("chain"), F.col("chain").alias("top"), F.col("dist").alias("more"))
        moved = cut_lineage(open_ones.join(up, ["tree", "chain"]).select(
            "tree", "node", "parent", "score", F.col("top").alias("chain"), (F.col("dist") + F.col("more")).alias("dist")
        ))
        reach *= 2
        done = done.union(moved.where(F.col("dist") < reach).select(columns))
        open_ones = moved.where(F.col("dist") >= reach).select(columns)
    return done  # what is left over has no first message: it replies to itself in a circle


def best_paths(messages: DataFrame, top_k: int | None = 1) -> DataFrame:
    """(tree, rank, tree_path, score) of root-to-leaf paths, and with them the nodes: one row per (path, node).

    ``messages`` has tree, node, parent, score. The unbranched runs are joined level by level of the branching, so the
    number of self-joins is the number of branchings on the longest path, not its number of messages. A path's score is
    the sum of its messages' scores (null: 0); ties go to the smaller nodes from the root on. ``top_k=None`` keeps all.
    """
    placed = _chains(messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")))
    placed = cut_lineage(placed)
    chain_of = placed.select("tree", F.col("node").alias("parent"), F.col("chain").alias("upper"))
    runs = placed.groupBy("tree", "chain").agg(F.sum("score").alias("run_score")).join(
        placed.where("dist = 0").select("tree", "chain", "parent"), ["tree", "chain"]
    ).join(chain_of, ["tree", "parent"], "left").select("tree", "chain", "upper", "run_score")
    runs = cut_lineage(runs)
    lower = runs.where("upper IS NOT NULL")
    uppers = lower.select("tree", F.col("upper").alias("chain"), F.lit(True).alias("goes_on")).distinct()
    ends = cut_lineage(runs.join(uppers, ["tree", "chain"], "left").where("goes_on IS NULL").select("tree", "chain"))
    frontier = runs.where("upper IS NULL").select(
        "tree", "chain", F.col("run_score").alias("path_score"), F.array("chain").alias("path")
    )
    found = frontier
    branched = lower.limit(1).count() > 0
    while branched:
        step = lower.select("tree", F.col("upper").alias("chain"), F.col("chain").alias("next"), "run_score")
        frontier = cut_lineage(frontier.join(step, ["tree", "chain"]).select(
            "tree", F.col("next").alias("chain"), (F.col("path_score") + F.col("run_score")).alias("path_score"),
            F.concat("path", F.array("next")).alias("path"),
        ))
        branched = frontier.limit(1).count() > 0
        found = found.union(frontier)
    whole = found.join(ends, ["tree", "chain"])
    order = Window.partitionBy("tree").orderBy(F.desc("path_score"), "path")
    ranked = whole.withColumn("rank", F.row_number().over(order))
    if top_k is not None:
        ranked = ranked.where(F.col("rank") <= top_k)
    steps = ranked.select("tree", "rank", "path_score", F.posexplode("path").alias("at", "chain"))
    return steps.join(placed.select("tree", "chain", "dist", "node"), ["tree", "chain"]).select(
        "tree", "rank", "path_score", "at", "dist", "node"
    )


def format_trees(messages: DataFrame, top_k: int | None = 1, trained_role: str = "assistant") -> DataFrame:
    """One conversation per chosen path: (tree, rank, path_score, formatted, segments).

    ``messages`` has tree, node, parent, role, text, score; node is unique in its tree, and a message whose parent is
    null or absent starts a tree's path. ``segments`` cut ``formatted`` into pieces with a ``loss`` flag that is true for
    exactly the texts of ``trained_role``; their pieces joined are ``formatted``.

    Null role or text: empty. Rows with a null tree or node belong nowhere and are left out, as are messages that reply
    to each other in a circle. A text's size is bounded by the path it formats; no other group is gathered. Other
    columns are not kept, so that none can clash. An empty table gives an empty result.
    """
    usable = messages.where("tree IS NOT NULL AND node IS NOT NULL")
    steps = best_paths(usable, top_k)
    trained = F.col("role") == trained_role
    said = usable.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = steps.join(said, ["tree", "node"]).select(
        "tree", "rank", "path_score", F.struct(
            "at", "dist", F.concat(F.lit(TURN_OPEN), escape_role(F.col("role")), F.lit("\n")).alias("open"),
            escape(F.col("text")).alias("body"), trained.alias("loss"),
        ).alias("turn"),
    )
    gathered = parts.groupBy("tree", "rank").agg(
        F.first("path_score").alias("path_score"), F.array_sort(F.collect_list("turn")).alias("turns")
    )

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("piece"), loss.alias("loss"))

    segments = F.flatten(F.transform("turns", lambda t: F.array(
        piece(t["open"], F.lit(False)), piece(t["body"], t["loss"]), piece(F.lit(TURN_CLOSE), F.lit(False))
    )))
    return gathered.select("tree", "rank", "path_score", segments.alias("segments")).select(
        "tree", "rank", "path_score", F.array_join("segments.piece", "").alias("formatted"), "segments"
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped: array of (role, text)."""
    blocks = F.split(formatted, TURN_CLOSE.replace("|", "\\|"))
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turn(block: Column) -> Column:
        inner = F.substring(block, F.lit(len(TURN_OPEN) + 1), F.length(block))
        line = F.instr(inner, "\n")
        role = F.substring(inner, F.lit(1), line - 1)
        text = F.substring(inner, line + 1, F.length(inner))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(blocks, turn)


def loss_text(segments: Column) -> Column:
    """What the loss mask covers, unescaped and joined."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["piece"])), "")
