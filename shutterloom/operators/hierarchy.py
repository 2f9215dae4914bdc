"""Parent-child rows to roots, depths, paths and descendants, with cycles reported.

The links form a functional graph (every node has at most one parent). The solver picks splitters by a hash of the
node id, walks every node to the next splitter above it, solves the reduced graph of splitters, and joins the two:

1. *Walk*: pointers are squared (each round joins the walkers that have not arrived with the pointers of the
   non-splitters), so a gap of g links takes log2(g) rounds; with one splitter in ``spacing`` nodes gaps are short.
2. *Reduced graph*: the same squaring over the splitters alone, a ``1/spacing`` part of the nodes.
3. *Cycles*: a walk that never arrives has, once 2^k exceeds the number of unfinished walkers, its pointer on the
   cycle, and the smallest id seen from a node on the cycle is the smallest of the whole cycle. This serves cycles
   without any splitter in step 1 and cycles through splitters in step 2.

No step gathers a tree in one task: stars, chains and forests all move as rows of joins, so a target that absorbed a
third of all rows is only a frequent join key on the side that AQE may split or broadcast.

Defined results: rows with a null id are left out; repeated rows of one id count once, with their smallest non-null
parent; a parent that is not an id ends the chain at its holder; a node that is its own parent is a cycle of one; an
empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterloom.session import cut_lineage

SPACING = 8
_SEED = 40503


def _is_splitter(node: Column, spacing: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(_SEED)), F.lit(spacing)) == 0


def clean_links(rows: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, parent, linked): parent is null where the chain ends here; linked tells whether the row named a parent."""
    links = (
        rows.select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent"))
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("parent").alias("parent"))
    )
    known = links.select(F.col("id").alias("known"))
    return links.join(known, F.col("parent") == F.col("known"), "left").select(
        "id", F.col("known").alias("parent"), F.col("parent").isNotNull().alias("linked")
    )


def _square(walkers: DataFrame, via: DataFrame) -> DataFrame:
    """One round: each unfinished walker continues from where its pointer stands."""
    step = via.select(
        F.col("id").alias("v_id"),
        F.col("nxt").alias("v_nxt"),
        F.col("hops").alias("v_hops"),
        F.col("low").alias("v_low"),
        F.col("done").alias("v_done"),
    )
    return walkers.join(step, (F.col("nxt") == F.col("v_id")) & ~F.col("done"), "left").select(
        "id",
        F.coalesce("v_nxt", "nxt").alias("nxt"),
        (F.col("hops") + F.coalesce("v_hops", F.lit(0))).alias("hops"),
        F.least("low", F.coalesce("v_low", "low")).alias("low"),
        (F.col("done") | F.coalesce("v_done", F.lit(False))).alias("done"),
    )


def _chase(walkers: DataFrame, through) -> DataFrame:
    """Square until every walker has arrived or provably never will.

    With u walkers unfinished after k rounds, the farthest that still arrives is at most u + 2^k links away; so the
    round after 2^k >= u is the last one needed, and then pointers of the rest stand on their cycles.
    """
    walkers = cut_lineage(walkers)
    covered = 1
    while True:
        left = walkers.where(~F.col("done")).count()
        if not left:
            return walkers
        last = covered >= left
        walkers = cut_lineage(_square(walkers, through(walkers)), replaces=walkers)
        covered *= 2
        if last:
            return walkers


def _cycle_roots(stuck: DataFrame) -> DataFrame:
    """(id, root) of walkers that never arrive: the smallest id on the cycle under their pointer."""
    at = stuck.select(F.col("nxt").alias("at")).distinct()
    lows = stuck.join(at, F.col("id") == F.col("at"), "left_semi").select(
        F.col("id").alias("c_id"), F.col("low").alias("c_low")
    )
    return stuck.join(lows, F.col("nxt") == F.col("c_id")).select("id", F.col("c_low").alias("root"))


def _solve(links: DataFrame, spacing: int) -> tuple[DataFrame, DataFrame]:
    """(all linked nodes with their next stop, stops with their root and depth; depth -1 on a cycle)."""
    stops = links.where(F.col("parent").isNull()).select(F.col("id").alias("stop"))
    moving = links.where(F.col("parent").isNotNull())
    start = moving.join(stops, F.col("parent") == F.col("stop"), "left").select(
        "id",
        F.col("parent").alias("nxt"),
        F.lit(1).cast("long").alias("hops"),
        F.least("id", "parent").alias("low"),
        (F.col("stop").isNotNull() | _is_splitter(F.col("parent"), spacing)).alias("done"),
        F.col("stop").isNotNull().alias("at_root"),
    )
    walk = _chase(start.drop("at_root"), lambda w: w.where(~_is_splitter(F.col("id"), spacing)))

    # terminals of the reduced graph: roots, and splitters whose walk runs into a cycle without splitters
    lost = _cycle_roots(walk.where(~F.col("done")))
    terminals = stops.select("stop", F.col("stop").alias("root"), F.lit(0).cast("long").alias("depth")).unionByName(
        lost.where(_is_splitter(F.col("id"), spacing)).select(F.col("id").alias("stop"), "root", F.lit(-1).cast("long").alias("depth"))
    )
    reduced = (
        walk.where(F.col("done") & _is_splitter(F.col("id"), spacing))
        .join(terminals.select("stop"), F.col("nxt") == F.col("stop"), "left")
        .select("id", "nxt", "hops", "low", F.col("stop").isNotNull().alias("done"))
    )
    solved = _chase(reduced, lambda w: w)
    arrived = (
        solved.where("done")
        .join(terminals, F.col("nxt") == F.col("stop"))
        .select(F.col("id").alias("stop"), "root", F.when(F.col("depth") < 0, F.col("depth")).otherwise(F.col("hops")).alias("depth"))
    )
    looped = _cycle_roots(solved.where(~F.col("done"))).select(
        F.col("id").alias("stop"), "root", F.lit(-1).cast("long").alias("depth")
    )
    return walk, terminals.unionByName(arrived).unionByName(looped)


def resolve(rows: DataFrame, id_col: str, parent_col: str, spacing: int = SPACING) -> DataFrame:
    """(id, root_id, depth, linked) for every node; see the module text for the cases."""
    links = cut_lineage(clean_links(rows, id_col, parent_col))
    walk, stops = _solve(links, spacing)
    arrived = (
        walk.where("done")
        .join(stops, F.col("nxt") == F.col("stop"))
        .select("id", F.col("root").alias("root_id"), F.when(F.col("depth") < 0, F.col("depth")).otherwise(F.col("depth") + F.col("hops")).alias("depth"))
    )
    looped = _cycle_roots(walk.where(~F.col("done"))).select("id", F.col("root").alias("root_id"), F.lit(-1).cast("long").alias("depth"))
    solved = arrived.unionByName(looped)
    ends = links.where(F.col("parent").isNull()).select("id", F.col("id").alias("root_id"), F.lit(0).cast("long").alias("depth"))
    linked = links.select("id", "linked")
    return solved.withColumn("linked", F.lit(True)).unionByName(ends.join(linked, "id"))


def paths(rows: DataFrame, id_col: str, parent_col: str, spacing: int = SPACING) -> DataFrame:
    """(id, root_id, depth, path): path runs from the root down to the node, both included; null on cycles.

    Segments between stops are built by the same squaring as the walk, and paths of the splitters from segments, so
    the only long arrays are the answers themselves.
    """
    links = cut_lineage(clean_links(rows, id_col, parent_col))
    found = cut_lineage(resolve(rows, id_col, parent_col, spacing))
    tree = links.join(found.where(F.col("depth") >= 0).select("id", "depth"), "id")
    seg = tree.where(F.col("parent").isNotNull()).select(
        "id",
        F.col("parent").alias("nxt"),
        F.array("id").alias("seg"),
        (_is_splitter(F.col("parent"), spacing) | (F.col("depth") == 1)).alias("done"),
    )

    def extend(part: DataFrame, via: DataFrame) -> DataFrame:
        step = via.select(F.col("id").alias("v_id"), F.col("nxt").alias("v_nxt"), F.col("seg").alias("v_seg"), F.col("done").alias("v_done"))
        return part.join(step, (F.col("nxt") == F.col("v_id")) & ~F.col("done"), "left").select(
            "id",
            F.coalesce("v_nxt", "nxt").alias("nxt"),
            F.when(F.col("v_seg").isNull(), F.col("seg")).otherwise(F.concat("seg", "v_seg")).alias("seg"),
            (F.col("done") | F.coalesce("v_done", F.lit(False))).alias("done"),
        )

    seg = cut_lineage(seg)
    while seg.where(~F.col("done")).limit(1).count():
        seg = cut_lineage(extend(seg, seg.where(~_is_splitter(F.col("id"), spacing))), replaces=seg)

    ends = tree.where(F.col("parent").isNull()).select(F.col("id").alias("end"))
    up = seg.where(_is_splitter(F.col("id"), spacing)).join(ends, F.col("nxt") == F.col("end"), "left").select(
        "id", "nxt", "seg", F.col("end").isNotNull().alias("done")
    )
    up = cut_lineage(up)
    while up.where(~F.col("done")).limit(1).count():
        up = cut_lineage(extend(up, up), replaces=up)
    above = up.select(F.col("id").alias("stop"), F.concat("seg", F.array("nxt")).alias("rest")).unionByName(
        ends.select(F.col("end").alias("stop"), F.array("end").alias("rest"))
    )
    whole = seg.join(above, F.col("nxt") == F.col("stop")).select("id", F.reverse(F.concat("seg", "rest")).alias("path"))
    whole = whole.unionByName(ends.select(F.col("end").alias("id"), F.array("end").alias("path")))
    return found.join(whole, "id", "left").select("id", "root_id", "depth", "path")


def descendants(rows: DataFrame, id_col: str, parent_col: str, spacing: int = SPACING) -> DataFrame:
    """(ancestor_id, descendant_id, distance): one row for each node below another; none within cycles."""
    p = paths(rows, id_col, parent_col, spacing).where(F.col("depth") > 0)
    return p.select(F.col("id").alias("descendant_id"), "depth", F.posexplode("path").alias("pos", "ancestor_id")).where(
        F.col("pos") < F.col("depth")
    ).select("ancestor_id", "descendant_id", (F.col("depth") - F.col("pos")).cast("long").alias("distance"))
