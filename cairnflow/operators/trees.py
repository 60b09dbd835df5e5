"""Search trees as node tables (schema.NODE): statistics, paths, selection.

A tree's nodes are gathered into one array, sorted by id, in one shuffle by problem. Nodes refer to each other by their
places in it, so a lookup costs the same however large the tree; paths of any depth are found by doubling (a node's known
ancestors are extended by those of the last one), in as many rounds as the number of nodes has binary digits. Ids may
have gaps: places are then searched. A parent that is not in the table is none; a chain of parents that doesn't end is an
error. What needs a node's children groups by parent instead, without gathering trees.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ALL = 1 << 30  # of a slice's length; more would overflow beside its start


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, computed once: an expression named in a lambda would run for each of its elements."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _place(ids: Column, node: Column) -> Column:
    """Place of a node in the sorted ids, 0 for none."""
    first, last = F.element_at(ids, 1), F.element_at(ids, -1)
    dense = last - first + 1 == F.size(ids)
    inside = F.when((node >= first) & (node <= last), node - first + 1).otherwise(0)
    return F.coalesce(F.when(node.isNull(), 0).when(dense, inside).otherwise(F.array_position(ids, node)).cast("int"), F.lit(0))


def _gather(nodes: DataFrame) -> DataFrame:
    """A row per tree: problem_id, tree (node_id, row), ids, all in order of node_id."""
    pairs = F.array_sort(F.collect_list(F.struct("node_id", F.struct(*nodes.columns).alias("row"))))
    return nodes.groupBy("problem_id").agg(pairs.alias("tree")).withColumn("ids", F.transform("tree", lambda x: x["node_id"]))


def _upward(ids: Column, parents: Column) -> Column:
    """Places from each node up to its root, the node's own first; parents: ids."""

    def paths(up: Column) -> Column:
        known = F.transform(up, lambda p, i: F.when(p == 0, F.array(i + 1)).otherwise(F.array(i + 1, p)))
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(up))).cast("int"))
        last = lambda a: F.element_at(a, -1)
        longer = lambda every, a: F.when(F.element_at(up, last(a)) == 0, a).otherwise(F.concat(a, F.slice(F.element_at(every, last(a)), 2, _ALL)))
        found = F.aggregate(rounds, known, lambda every, _: F.transform(every, lambda a: longer(every, a)))
        ended = lambda a: F.when(F.size(a) > F.size(up), F.raise_error(F.lit("a chain of parents doesn't end")).cast("array<int>")).otherwise(a)
        return F.transform(found, ended)

    return _let(ids, lambda known: _let(F.transform(parents, lambda p: _place(known, p)), paths))


def _with_upward(nodes: DataFrame) -> DataFrame:
    """_gather(nodes) with up: for each node the places of itself and its ancestors."""
    return _gather(nodes).withColumn("up", _upward(F.col("ids"), F.transform("tree", lambda x: x["row"]["parent_id"])))


def with_paths(nodes: DataFrame) -> DataFrame:
    """nodes with path (ids from the root to the node) and depth."""
    nodes = nodes.drop("path", "depth")
    each = F.transform("up", lambda a, i: F.struct(F.element_at("tree", i + 1)["row"].alias("row"), F.transform(F.reverse(a), lambda p: F.element_at("ids", p)).alias("path")))
    return _with_upward(nodes).select(F.explode(each).alias("n")).select("n.row.*", "n.path", (F.size("n.path") - 1).alias("depth"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """problem_id, node_id, ancestor_id (itself included), distance. nodes has path."""
    return nodes.select("problem_id", "node_id", F.posexplode(F.reverse("path")).alias("distance", "ancestor_id"))


def backpropagate(nodes: DataFrame, rollouts: DataFrame) -> DataFrame:
    """nodes (with path) with visit_count and total_value: each rollout (problem_id, node_id, reward) counts at its node and all its ancestors.

    Everything is keyed by problem, so nodes and rollouts are each shuffled once.
    """
    nodes = nodes.drop("visit_count", "total_value")
    ends = rollouts.groupBy("problem_id").agg(F.collect_list(F.struct("node_id", "reward")).alias("ends"))
    whole = _gather(nodes).join(ends, "problem_id", "left")
    none = F.lit(None).cast(nodes.select(F.struct(*nodes.columns).alias("row")).schema["row"].dataType)
    entry = lambda node, n, w, row: F.struct(node.alias("node"), F.lit(n).cast("long").alias("n"), w.cast("double").alias("w"), row.alias("row"))
    own = F.transform("tree", lambda x: entry(x["node_id"], 0, F.lit(0.0), x["row"]))
    at = lambda e: _place(F.col("ids"), e["node_id"])
    known = F.filter(F.coalesce("ends", F.array().cast(ends.schema["ends"].dataType)), lambda e: at(e) > 0)
    met = F.flatten(F.transform(known, lambda e: F.transform(F.element_at("tree", at(e))["row"]["path"], lambda node: entry(node, 1, e["reward"], none))))
    each = whole.select("problem_id", F.explode(F.concat(own, met)).alias("x")).select("problem_id", "x.*")
    sums = each.groupBy("problem_id", "node").agg(F.first("row", ignorenulls=True).alias("row"), F.sum("n").alias("visit_count"), F.sum("w").alias("total_value"))
    return sums.select("row.*", "visit_count", "total_value")


def q_value(visits: Column, value: Column) -> Column:
    return F.when(visits == 0, 0.0).otherwise(value / visits)


def uct(visits: Column, value: Column, parent_visits: Column, c: float = 1.4) -> Column:
    """Unvisited nodes score infinity; an unvisited parent adds no exploration."""
    explore = F.lit(c) * F.sqrt(F.ln(F.greatest(parent_visits, F.lit(1))) / visits)
    return F.when(visits == 0, F.lit(float("inf"))).otherwise(value / visits + explore)


def with_children(nodes: DataFrame, *fields: str) -> DataFrame:
    """nodes with children: the fields of each child, in order of child_ord and node_id.

    Each node goes to its own group and to its parent's: one exchange, or none where nodes are dealt by problem already.
    """
    row, child = F.struct(*nodes.columns), F.struct("child_ord", "node_id", F.struct(*fields).alias("fields"))
    none_row, none_child = (F.lit(None).cast(nodes.select(x.alias("x")).schema["x"].dataType) for x in (row, child))
    own = F.struct(F.col("node_id").alias("k"), row.alias("row"), none_child.alias("child"))
    to_parent = F.struct(F.col("parent_id").alias("k"), none_row.alias("row"), child.alias("child"))
    both = F.when(F.col("parent_id").isNull(), F.array(own)).otherwise(F.array(own, to_parent))
    each = nodes.select("problem_id", F.explode(both).alias("x")).select("problem_id", "x.*")
    grouped = each.groupBy("problem_id", "k").agg(F.first("row", ignorenulls=True).alias("row"), F.array_sort(F.collect_list("child")).alias("children"))
    return grouped.where("row is not null").select("row.*", F.transform("children", lambda x: x["fields"]).alias("children"))


def _scored(nodes: DataFrame, c: float, *more: str) -> DataFrame:
    """nodes with children (uct, first, node_id, more): the largest struct is the best child, the first of equals."""
    found = with_children(nodes, *dict.fromkeys(("node_id", "child_ord", "visit_count", "total_value", *more)))
    score = lambda x: uct(x["visit_count"], x["total_value"], F.col("visit_count"), c)
    return found.withColumn("children", F.transform("children", lambda x: F.struct(score(x).alias("uct"), (-x["child_ord"]).alias("first"), x["node_id"].alias("node_id"), *[x[m].alias(m) for m in more if m != "node_id"])))


def with_uct(nodes: DataFrame, c: float = 1.4) -> DataFrame:
    """nodes (no root has a score) with uct."""
    found = with_children(nodes, *nodes.columns)
    score = lambda x: uct(x["visit_count"], x["total_value"], F.col("visit_count"), c)
    scored = F.transform("children", lambda x: F.struct(x.alias("row"), score(x).alias("uct")))
    root = F.struct(F.struct(*nodes.columns).alias("row"), F.lit(None).cast("double").alias("uct"))
    return found.select(F.explode(F.when(F.col("parent_id").isNull(), F.concat(F.array(root), scored)).otherwise(scored)).alias("x")).select("x.row.*", "x.uct")


def best_children(nodes: DataFrame, c: float = 1.4) -> DataFrame:
    """problem_id, node_id, best_child_id, uct: of each parent the child of highest score, the first of equals. No sort, no window."""
    top = _scored(nodes, c).select("problem_id", "node_id", F.array_max("children").alias("top"))
    return top.where("top is not null").select("problem_id", "node_id", F.col("top.node_id").alias("best_child_id"), F.col("top.uct").alias("uct"))


def descend(nodes: DataFrame, c: float = 1.4) -> DataFrame:
    """problem_id, leaf_id, steps: where selection ends from the root, going to best children until a terminal node or one without children."""
    after = F.when(~F.col("is_terminal"), F.array_max("children")["node_id"])
    slim = _scored(nodes, c).select("problem_id", "node_id", "parent_id", after.alias("after"))
    whole = slim.groupBy("problem_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "after"))).alias("tree"), F.min(F.when(F.col("parent_id").isNull(), F.col("node_id"))).alias("root"))

    def walk(ids: Column) -> Column:
        step = lambda s: F.struct(_place(ids, F.element_at("tree", s["at"])["after"]).alias("at"), (s["steps"] + 1).alias("steps"))
        on = lambda s: (s["at"] > 0) & F.element_at("tree", s["at"])["after"].isNotNull()
        return F.aggregate(ids, F.struct(_place(ids, F.col("root")).alias("at"), F.lit(0).alias("steps")), lambda s, _: F.when(on(s), step(s)).otherwise(s))

    end = whole.select("problem_id", "tree", _let(F.transform("tree", lambda x: x["node_id"]), walk).alias("end")).where("end.at > 0")
    return end.select("problem_id", F.element_at("tree", F.col("end.at"))["node_id"].alias("leaf_id"), "end.steps")


def with_child_counts(nodes: DataFrame) -> DataFrame:
    """nodes with n_children."""
    return with_children(nodes, "node_id").withColumn("n_children", F.size("children")).drop("children")


def is_fully_expanded() -> Column:
    return F.col("is_terminal") | (F.col("n_children") > 0)


def needs_expansion(max_depth: int = 16) -> Column:
    return ~F.col("is_terminal") & (F.col("depth") < max_depth)


def needs_simulation() -> Column:
    return ~(F.col("is_terminal") & F.col("reward").isNotNull())


def terminal_paths(nodes: DataFrame) -> DataFrame:
    """A row per terminal node without a terminal ancestor, in preorder: problem_id, node_id, traj_ord, steps (actions), visit_count, reward, length, max_q_value."""
    slim = nodes.select("problem_id", "node_id", "parent_id", "child_ord", "action", "visit_count", "total_value", "reward", "is_terminal")
    at = lambda p: F.element_at("tree", p)["row"]
    ends = F.filter("up", lambda a: at(F.element_at(a, 1))["is_terminal"] & ~F.exists(F.slice(a, 2, _ALL), lambda p: at(p)["is_terminal"]))

    def shown(a: Column) -> Column:
        own, down = at(F.element_at(a, 1)), F.reverse(a)
        qs = F.transform(F.filter(a, lambda p: at(p)["visit_count"] > 0), lambda p: at(p)["total_value"] / at(p)["visit_count"])
        steps = F.transform(F.slice(down, 2, _ALL), lambda p: at(p)["action"])
        return F.struct(
            F.transform(down, lambda p: F.coalesce(at(p)["child_ord"], F.lit(-1))).alias("place"), own["node_id"].alias("node_id"), steps.alias("steps"), own["visit_count"].alias("visit_count"),
            F.coalesce(own["reward"], F.lit(0.0)).alias("reward"), (F.size(a) - 1).alias("length"), F.coalesce(F.array_max(qs), F.lit(0.0)).alias("max_q_value"),
        )

    found = _with_upward(slim).select("problem_id", F.posexplode(F.array_sort(F.transform(ends, shown))).alias("i", "x"))
    return found.select("problem_id", "x.node_id", "x.steps", "x.visit_count", "x.reward", "x.length", "x.max_q_value", (F.col("i") + 1).alias("traj_ord"))


def prefix_visits(nodes: DataFrame, lookups: DataFrame) -> DataFrame:
    """lookups (problem_id, steps) with visits: of the deepest node that following steps reaches, at each node to the first child of that action."""
    slim = with_children(nodes.select("problem_id", "node_id", "parent_id", "child_ord", "action", "visit_count"), "action", "node_id")
    rows = F.array_sort(F.collect_list(F.struct("node_id", "visit_count", "children")))
    whole = slim.groupBy("problem_id").agg(rows.alias("tree"), F.min(F.when(F.col("parent_id").isNull(), F.col("node_id"))).alias("root"))
    whole = whole.withColumn("ids", F.transform("tree", lambda x: x["node_id"]))
    joined = lookups.join(whole, "problem_id")

    def after(at: Column, step: Column) -> Column:
        """Place of the first child by that action, 0 for none."""
        hits = F.filter(F.element_at("tree", at)["children"], lambda x: x["action"] == step)
        return _place(F.col("ids"), F.get(hits, F.lit(0))["node_id"])

    go = lambda s, step: _let(after(s["at"], step), lambda p: F.struct(F.when(p > 0, p).otherwise(s["at"]).alias("at"), (p > 0).alias("on")))
    start = F.struct(_place(F.col("ids"), F.col("root")).alias("at"), F.lit(True).alias("on"))
    walk = F.aggregate("steps", start, lambda s, step: F.when(s["on"], go(s, step)).otherwise(s))
    return joined.withColumn("visits", F.element_at("tree", walk["at"])["visit_count"]).drop("tree", "root", "ids")
