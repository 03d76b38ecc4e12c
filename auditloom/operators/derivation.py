"""Derivation graph of a source register: loops, origins, and whether two sources are independent.

Each source names at most one origin, so a project's register is a forest whose roots may be loops.
Two sources rest on one disclosure exactly when they end in the same root or loop, which turns the
independence test into one equality. Roots are found by pointer doubling: every round joins a
pointer table with itself and doubles the reach, so a chain of n sources takes log2(n) rounds and
never lists all pairs of a chain. Each round is written to the shared folder.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import strip
from auditloom.operators.findings import union_all
from auditloom.operators.registers import last_rows
from auditloom.session import written


class Forest(NamedTuple):
    """``levels[k]`` points 2**k steps up (columns project_id, v, up, steps, ended), for the walks
    that were still open before it.

    ``tops`` has project_id, v, root, depth for every source that names an origin. ``loops`` has
    project_id, v, loop, place, size for every source on a loop. ``parents`` are the edges.
    """

    parents: DataFrame
    levels: list[DataFrame]
    tops: DataFrame
    loops: DataFrame | None


def parents_of(sources: DataFrame) -> DataFrame:
    """(project_id, sid, origin): the origin the last row of each source id records; '' for none."""
    rows = sources.select("project_id", "row_no", strip(F.col("source_id")).alias("sid"),
                          strip(F.col("derived_from")).alias("origin"))
    return last_rows(rows, ["project_id", "sid"]).select("project_id", "sid", "origin")


def _is_open() -> Column:
    return ~F.col("ended") & F.col("loop").isNull()


def _metrics() -> list[Column]:
    return [F.count_if(_is_open()).alias("open"),
            F.count_if(_is_open() & (F.col("low") == F.col("v"))).alias("heads")]


def _label_loops(table: DataFrame, metrics: dict, reach: int) -> tuple[DataFrame, dict]:
    """Label rows that pass through a loop which has just closed; most registers have none.

    Only the smallest vertex of a loop can meet itself as the smallest id on its own walk.
    """
    if not metrics["heads"]:
        return table, metrics
    heads = table.filter(_is_open() & (F.col("low") == F.col("v"))).select(
        "project_id", F.col("v").alias("low"), F.col("v").alias("closed"))
    labelled = table.join(heads, ["project_id", "low"], "left").withColumns({
        "found_at": F.when(F.col("closed") == F.col("v"), F.lit(reach)).otherwise(F.col("found_at")),
        "loop": F.coalesce("loop", F.when(~F.col("ended"), F.col("closed")))}).drop("closed")
    return written(labelled, *_metrics())


def _double(edges: DataFrame) -> tuple[list[DataFrame], int]:
    """Pointer doubling until every walk has ended or is known to run into a loop.

    A round reads and writes the walks still open; settled ones stay where they were written. Returns the pointer tables and the number of loops that were met.
    """
    starts = edges.select("project_id", F.col("v").alias("up"), F.lit(True).alias("goes_on"))
    first = edges.join(starts, ["project_id", "up"], "left").select(
        "project_id", "v", "up", F.lit(1).cast("bigint").alias("steps"),
        F.col("goes_on").isNull().alias("ended"), F.col("up").alias("low"),
        F.lit(None).cast("string").alias("loop"), F.lit(None).cast("int").alias("found_at"))
    table, metrics = written(first, *_metrics())
    loops = metrics["heads"]
    table, metrics = _label_loops(table, metrics, 0)
    levels = [table]
    while metrics["open"]:
        going = levels[-1].filter(_is_open())
        ahead = going.unionByName(_settled(levels)).select(
            "project_id", F.col("v").alias("up"), F.col("up").alias("next_up"),
            F.col("steps").alias("next_steps"), F.col("ended").alias("next_ended"),
            F.col("low").alias("next_low"), F.col("loop").alias("next_loop"))
        moved = going.join(ahead, ["project_id", "up"]).select(
            "project_id", "v", F.col("next_up").alias("up"),
            (F.col("steps") + F.col("next_steps")).alias("steps"),
            F.col("next_ended").alias("ended"), F.least("low", "next_low").alias("low"),
            F.col("next_loop").alias("loop"), "found_at")
        table, metrics = written(moved, *_metrics())
        loops += metrics["heads"]
        table, metrics = _label_loops(table, metrics, len(levels))
        levels.append(table)
    return levels, loops


def _settled(levels: list[DataFrame]) -> DataFrame:
    """The rows of all walks that have ended or run into a loop, each from the level where it did."""
    return union_all([level.filter(~_is_open()) for level in levels])


def _hops(walks: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The walks (project_id, ..., v, hops) as one row per hop: v and hops give way to hop, ancestor.

    A walk of more than 2**k hops is cut in two at its vertex 2**k steps up, level by level, so the
    rows double towards the single hops: a list of n hops costs 2n rows in all, not n per level.
    """
    keys = [c for c in walks.columns if c not in ("v", "hops")]
    parts = walks.withColumn("past", F.lit(0).cast("bigint"))
    for k in reversed(range(len(levels))):
        reach = F.lit(2 ** k).cast("bigint")
        far = F.col("hops") > reach
        parts = parts.join(_jump(levels, k, "_at", "_to"), (F.col("project_id") == F.col("_p"))
                           & (F.col("v") == F.col("_at")) & far, "left")
        near_part = F.struct("v", F.least("hops", reach).alias("hops"), "past")
        far_part = F.when(far, F.struct(F.col("_to").alias("v"), (F.col("hops") - reach).alias("hops"),
                                        (F.col("past") + reach).alias("past")))
        parts = parts.select(*keys, F.explode(F.array_compact(F.array(near_part, far_part))).alias("part")
                             ).select(*keys, "part.*")
    first = _jump(levels, 0, "v", "ancestor").withColumnRenamed("_p", "project_id")
    return parts.filter("hops = 1").join(first, ["project_id", "v"]).select(
        *keys, (F.col("past") + 1).alias("hop"), "ancestor")


def _loop_members(levels: list[DataFrame]) -> DataFrame:
    """Every vertex on a loop with its place, counted from the loop's smallest vertex.

    A loop is cut at that vertex, its head: the longest walk from the head that does not meet it again
    is found digit by digit (the smallest id met on a stretch tells whether the head lies on it), and
    its hops rank the other members. Until then each loop is one row.
    """
    heads = _settled(levels).filter("found_at IS NOT NULL").select(
        "project_id", F.col("v").alias("loop"), "v", F.lit(0).cast("bigint").alias("hops"))
    at = heads
    for k in reversed(range(len(levels))):
        stretch = levels[k].filter(F.col("steps") == 2 ** k).select(
            F.col("project_id").alias("_p"), F.col("v").alias("_at"), F.col("up").alias("_to"), "low")
        at = at.join(stretch, (F.col("project_id") == F.col("_p")) & (F.col("v") == F.col("_at")), "left")
        free = F.coalesce(F.col("low") != F.col("loop"), F.lit(False))
        at = at.select("project_id", "loop", F.when(free, F.col("_to")).otherwise(F.col("v")).alias("v"),
                       (F.col("hops") + F.when(free, 2 ** k).otherwise(0)).alias("hops"))
    sized, _ = written(at.withColumn("size", F.col("hops") + 1).withColumn("v", F.col("loop")))
    others = _hops(sized, levels).select("project_id", "loop", F.col("ancestor").alias("v"),
                                         F.col("hop").alias("place"), "size")
    return written(sized.select("project_id", "loop", "v", F.lit(0).cast("bigint").alias("place"), "size")
                   .unionByName(others))[0]


def forest(parents: DataFrame) -> Forest:
    parents = written(parents)[0]
    edges = parents.filter("origin <> ''").select(
        "project_id", F.col("sid").alias("v"), F.col("origin").alias("up"))
    levels, met = _double(edges)
    loops = _loop_members(levels) if met else None
    if loops is not None:
        # loop members become roots, so what is left has no cycle
        levels, _ = _double(edges.join(loops.select("project_id", "v"), ["project_id", "v"],
                                       "left_anti"))
    tops = _settled(levels).select("project_id", "v", F.col("up").alias("root"),
                             F.col("steps").alias("depth"))
    return Forest(parents, levels, tops, loops)


def located(rows: DataFrame, graph: Forest, name: str) -> DataFrame:
    """Add <name>_root, <name>_depth and <name>_top (root, or the loop the root lies on)."""
    tops = graph.tops.select("project_id", F.col("v").alias(name), F.col("root").alias("_root"),
                             F.col("depth").alias("_depth"))
    out = rows.join(tops, ["project_id", name], "left").withColumns({
        f"{name}_root": F.coalesce("_root", name),
        f"{name}_depth": F.coalesce("_depth", F.lit(0).cast("bigint"))}).drop("_root", "_depth")
    if graph.loops is None:
        return out.withColumns({f"{name}_top": F.col(f"{name}_root"),
                                f"{name}_loop": F.lit(None).cast("string")})
    loops = graph.loops.select("project_id", F.col("v").alias(f"{name}_root"),
                               F.col("loop").alias(f"{name}_loop"))
    return out.join(loops, ["project_id", f"{name}_root"], "left").withColumn(
        f"{name}_top", F.coalesce(f"{name}_loop", f"{name}_root"))


def _jump(levels: list[DataFrame], k: int, key: str, to: str) -> DataFrame:
    return levels[k].filter(F.col("steps") == 2 ** k).select(
        F.col("project_id").alias("_p"), F.col("v").alias(key), F.col("up").alias(to))


def lift(rows: DataFrame, levels: list[DataFrame], name: str, hops: str) -> DataFrame:
    """Move column ``name`` up by ``hops`` steps, one join per binary digit."""
    for k in range(len(levels)):
        due = F.col(hops).bitwiseAND(F.lit(2 ** k).cast("bigint")) != 0
        rows = rows.join(_jump(levels, k, "_at", "_to"), (F.col("project_id") == F.col("_p"))
                         & (F.col(name) == F.col("_at")) & due, "left")
        rows = rows.withColumn(name, F.coalesce("_to", name)).drop("_p", "_at", "_to")
    return rows


def ancestors(graph: Forest, starts: DataFrame) -> DataFrame:
    """Every origin of each start at any depth, nearest first: project_id, sid, hop, ancestor.

    A start is never its own ancestor; a walk that enters a loop lists each member once.
    """
    at = located(starts.select("project_id", "sid").distinct(), graph, "sid")
    tree = at.filter("sid_depth > 0").select("project_id", "sid", F.col("sid").alias("v"),
                                             F.col("sid_depth").alias("hops"))
    out = _hops(tree, graph.levels)
    if graph.loops is None:
        return out
    entry = graph.loops.select("project_id", F.col("v").alias("sid_root"), "loop",
                               F.col("place").alias("entry_place"), "size")
    around = (at.drop("sid_loop").join(entry, ["project_id", "sid_root"])
              .join(graph.loops.select("project_id", "loop", "v", "place"), ["project_id", "loop"])
              .withColumn("turn", F.pmod(F.col("place") - F.col("entry_place"), F.col("size")))
              .filter("turn > 0")
              .select("project_id", "sid", (F.col("sid_depth") + F.col("turn")).alias("hop"),
                      F.col("v").alias("ancestor")))
    return out.unionByName(around)


def loop_members(graph: Forest) -> DataFrame:
    """Sources whose derivation walk returns to them after at least one other source."""
    if graph.loops is None:
        return graph.parents.select("project_id", "sid").limit(0)
    return graph.loops.filter("size > 1").select("project_id", F.col("v").alias("sid"))


def independence_defects(pairs: DataFrame, graph: Forest) -> DataFrame:
    """Pairs (project_id, sid, other) that are one disclosure, with relation and shared origin.

    ``relation`` is 'origin' (other is an ancestor of sid), 'derivative' (sid is an ancestor of
    other) or 'shared' (nearest common origin in ``shared``). Equal ids count as 'shared'.
    """
    where = located(located(pairs.select("project_id", "sid", "other").distinct(), graph, "sid"),
                    graph, "other")
    same = where.filter(F.col("sid_top") == F.col("other_top"))
    if graph.loops is not None:
        same = written(same)[0]
    one_tree = same.filter(F.col("sid_root") == F.col("other_root"))
    gap = F.col("sid_depth") - F.col("other_depth")
    met = one_tree.withColumns({"a": F.col("sid"), "b": F.col("other"),
                                "up_a": F.greatest(gap, F.lit(0)),
                                "up_b": F.greatest(-gap, F.lit(0))})
    met = lift(lift(met, graph.levels, "a", "up_a"), graph.levels, "b", "up_b")
    level = met.withColumn("level_a", F.col("a")).withColumn("level_b", F.col("b"))
    for k in reversed(range(len(graph.levels))):
        apart = F.col("a") != F.col("b")
        level = (level
                 .join(_jump(graph.levels, k, "_a", "_ua"), (F.col("project_id") == F.col("_p"))
                       & (F.col("a") == F.col("_a")) & apart, "left").drop("_p", "_a")
                 .join(_jump(graph.levels, k, "_b", "_ub"), (F.col("project_id") == F.col("_p"))
                       & (F.col("b") == F.col("_b")) & apart, "left").drop("_p", "_b"))
        go = F.col("_ua") != F.col("_ub")
        level = level.withColumns({"a": F.when(go, F.col("_ua")).otherwise(F.col("a")),
                                   "b": F.when(go, F.col("_ub")).otherwise(F.col("b"))}
                                  ).drop("_ua", "_ub")
    # the walks now stand just below the meeting point unless they met by levelling alone
    parents = graph.parents.select("project_id", F.col("sid").alias("a"), "origin")
    level = level.join(parents, ["project_id", "a"], "left")
    met_at = F.when(F.col("level_a") == F.col("level_b"), F.col("level_a")).otherwise(
        F.col("origin"))
    relation = (F.when((met_at == F.col("other")) & (F.col("other") != F.col("sid")), "origin")
                .when((met_at == F.col("sid")) & (F.col("other") != F.col("sid")), "derivative")
                .otherwise("shared"))
    out = level.select("project_id", "sid", "other", relation.alias("relation"),
                       met_at.alias("shared"))
    if graph.loops is None:
        return out
    across = same.filter(F.col("sid_root") != F.col("other_root")).select(
        "project_id", "sid", "other",
        F.when(F.col("other_depth") == 0, "origin").when(F.col("sid_depth") == 0, "derivative")
        .otherwise("shared").alias("relation"),
        F.when(F.col("other_depth") == 0, F.col("other")).otherwise(F.col("sid_root"))
        .alias("shared"))
    return out.unionByName(across)


def derivation_paths(pairs: DataFrame, graph: Forest) -> DataFrame:
    """For (project_id, sid, target) where target is an origin of sid: the hops as text.

    A source on a loop is an origin of itself here; its path goes once round. Only the hops of the
    wanted paths are made, and their number follows from depths and places.
    """
    ends = located(located(pairs.select("project_id", "sid", "target").distinct(), graph, "sid"),
                   graph, "target").filter("sid_top = target_top")
    if graph.loops is None:
        ends = ends.withColumns({"tree": F.col("sid_depth") - F.col("target_depth"),
                                 "turn": F.lit(0).cast("bigint"), "loop": F.lit(None).cast("string")})
    else:
        spots = graph.loops.select("project_id", F.col("v").alias("sid_root"), "loop",
                                   F.col("place").alias("entry"), "size")
        goals = graph.loops.select("project_id", F.col("v").alias("target"), F.col("place").alias("goal"))
        ends = (ends.join(spots, ["project_id", "sid_root"], "left")
                .join(goals, ["project_id", "target"], "left"))
        round_ = F.pmod(F.col("goal") - F.col("entry"), F.col("size")) + F.when(
            F.col("sid") == F.col("target"), F.col("size")).otherwise(0)
        ends = ends.withColumns({
            "tree": F.when(F.col("goal").isNotNull(), F.col("sid_depth"))
            .otherwise(F.col("sid_depth") - F.col("target_depth")),
            "turn": F.coalesce(round_, F.lit(0))})
    keys = ["project_id", "sid", "target"]
    steps = _hops(ends.filter("tree > 0 AND (sid_root = target_root OR loop IS NOT NULL)").select(
        *keys, F.col("sid").alias("v"), F.col("tree").alias("hops")), graph.levels)
    if graph.loops is not None:
        turns = ends.filter("turn > 0").select(
            *keys, "loop", "entry", "size", "tree",
            F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("turn"))).alias("step")).withColumn(
            "place", F.pmod(F.col("entry") + F.col("step"), F.col("size")))
        steps = steps.unionByName(turns.drop("size").join(
            graph.loops.select("project_id", "loop", "place", F.col("v").alias("ancestor")),
            ["project_id", "loop", "place"]).select(*keys, (F.col("tree") + F.col("step")).alias("hop"), "ancestor"))
    hops = F.transform(F.array_sort(F.collect_list(F.struct("hop", "ancestor"))), lambda s: s["ancestor"])
    return steps.groupBy(*keys).agg(
        F.array_join(F.concat(F.array("sid"), hops), " derives from ").alias("path"),
        F.max_by("ancestor", "hop").alias("end")).filter("end = target").drop("end")


def loop_paths(graph: Forest) -> DataFrame:
    """(project_id, sid, path): once round the loop, from each member of a loop of several sources."""
    members = loop_members(graph)
    return derivation_paths(members.withColumn("target", F.col("sid")), graph).drop("target")


def with_routes(defects: DataFrame, graph: Forest) -> DataFrame:
    """Add ``route`` to independence defects: the path from each side to the shared origin."""
    up = defects.filter("relation <> 'derivative'").select("project_id", "sid", F.col("shared").alias("target"))
    down = defects.filter("relation <> 'origin'").select("project_id", F.col("other").alias("sid"),
                                                         F.col("shared").alias("target"))
    paths, _ = written(derivation_paths(up.unionByName(down), graph))
    mine = paths.select("project_id", "sid", F.col("target").alias("shared"), F.col("path").alias("up_path"))
    theirs = paths.select("project_id", F.col("sid").alias("other"), F.col("target").alias("shared"),
                          F.col("path").alias("down_path"))
    up_path = F.when(F.col("relation") != "derivative", F.col("up_path"))
    down_path = F.when(F.col("relation") != "origin", F.col("down_path"))
    return (defects.join(mine, ["project_id", "sid", "shared"], "left")
            .join(theirs, ["project_id", "other", "shared"], "left")
            .withColumn("route", F.concat_ws(", and ", up_path, down_path)).drop("up_path", "down_path"))
