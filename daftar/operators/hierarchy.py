"""Parent-child links to whole hierarchies by tree contraction.

Each round rakes all leaves and then splices out an independent set of nodes
from the unary chains (those whose hash is a local maximum on the chain), so a
forest shrinks to its roots in a logarithmic number of rounds whatever its
depth.  What a round removed is written with the node it hung on and its
distance to it; going back through the rounds yields roots and depths.  A cycle
has no leaf and no root: its core shrinks to one node that is its own parent.

A row of the state holds two ids, a length and the smallest id spliced out of
its link, never a list.  All state is in written tables; nothing but the
question whether any is left reaches the driver.  Going back reads what the
later rounds resolved, which shrinks by a factor a round, so all rounds together
read a multiple of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.session import Scratch


def _named(df: DataFrame, child: str, parent: str) -> DataFrame:
    return df.select(F.col(child).cast("string").alias("c"), F.col(parent).cast("string").alias("p")).where("c is not null and p is not null")


def links(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Distinct (c, p) links as strings; rows with a null end are no links.

    A child that names several parents is placed below the smallest;
    ``other_parents`` reports the rest.
    """
    return _named(df, child, parent).groupBy("c").agg(F.min("p").alias("p"))


def other_parents(df: DataFrame, child: str, parent: str) -> DataFrame:
    """(``node_id``, ``parent_id``): the links that a tree cannot hold, as their child hangs below a smaller parent already."""
    named = _named(df, child, parent).distinct()
    several = named.groupBy("c").agg(F.min("p").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return named.join(several, "c").where("p <> low").select(F.col("c").alias("node_id"), F.col("p").alias("parent_id"))


def resolve(df: DataFrame, child: str, parent: str) -> DataFrame:
    """One row per node: ``node_id``, ``root_id``, ``depth``, ``on_cycle``.

    Nodes on a cycle or below one have the smallest id of the cycle as root and
    depth -1; ``on_cycle`` tells the members of the cycle itself.  A node linked
    to itself is a cycle of one.  A parent without any child id is a root.  An
    empty table gives an empty result; repeated rows count once.
    """
    spark = df.sparkSession
    work = Scratch(spark, "hierarchy")

    def with_children(edges: DataFrame) -> DataFrame:
        """Edges with the number of children of their lower end, and one of them."""
        kids = edges.where("c <> p").groupBy(F.col("p").alias("c")).agg(F.count(F.lit(1)).alias("kids"), F.min("c").alias("kid"))
        return edges.join(kids, "c", "left")

    first = links(df, child, parent).select("c", "p", F.lit(1).cast("bigint").alias("w"), F.lit(None).cast("string").alias("low"))
    state = work.write(with_children(first), "s0")
    states, chosen_of = [], []
    while not state.isEmpty():
        n = len(states)
        states.append(state)
        # Rake: what nobody names as parent leaves with this state, as does a cycle that shrank to one node.
        rest = with_children(state.where("kids is not null").drop("kids", "kid"))
        # Compress: v with one child u and a parent p leaves when its hash is the largest among the spliceable of u, v, p.
        unary = rest.where("kids = 1 and c <> p").select("c", "p", "w", "low", "kid", F.xxhash64("c", F.lit(n)).alias("h"))
        up, down = unary.select(F.col("c").alias("p"), F.col("h").alias("hp")), unary.select(F.col("c").alias("kid"), F.col("h").alias("hk"))
        largest = "(hp is null or p = c or (h, c) > (hp, p)) and (hk is null or (h, c) > (hk, kid))"
        chosen = work.write(unary.join(up, "p", "left").join(down, "kid", "left").where(largest).select("c", "p", "w", "low", "kid"), f"c{n}")
        chosen_of.append(chosen)
        over = chosen.select(F.col("kid").alias("c"), F.col("c").alias("mid"), F.col("p").alias("up"), F.col("w").alias("w2"), F.col("low").alias("low2"))
        left = rest.join(chosen.select("c"), "c", "left_anti").join(over, "c", "left").select(
            "c", F.coalesce("up", "p").alias("p"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.least("low", "mid", "low2").alias("low")
        )
        state = work.write(with_children(left), f"s{n + 1}")

    columns = "node_id string, root_id string, depth int, on_cycle boolean"
    done = spark.createDataFrame([], columns)
    for n in reversed(range(len(states))):
        # A cycle that shrank to one node; then what this round spliced out, whose upper and lower neighbour are known; then what it raked.
        core = states[n].where("c = p and kids is null").select(F.col("c").alias("node_id"), F.least("c", "low").alias("root_id"), F.lit(-1).alias("depth"), F.lit(True).alias("on_cycle"))
        known = done.unionByName(core)
        above = known.select(F.col("node_id").alias("p"), "root_id", F.col("depth").alias("d"))
        # A parent that is not known has no parent itself: it is a root.
        root, depth = F.coalesce("root_id", "p").alias("root_id"), F.when(F.coalesce("d", F.lit(0)) >= 0, F.coalesce("d", F.lit(0)) + F.col("w")).otherwise(-1).cast("int").alias("depth")
        # The parent of a node on a cycle is on it too, so a spliced node is on one if its child is.
        ring = known.where("on_cycle").select(F.col("node_id").alias("kid"), F.lit(True).alias("ring"))
        spliced = chosen_of[n].join(above, "p", "left").join(ring, "kid", "left").select(F.col("c").alias("node_id"), root, depth, F.coalesce("ring", F.lit(False)).alias("on_cycle"))
        spliced = work.write(core.unionByName(spliced), f"done/step={2 * n + 1}")
        below = done.unionByName(spliced).select(F.col("node_id").alias("p"), "root_id", F.col("depth").alias("d"))
        raked = states[n].where("kids is null and c <> p").join(below, "p", "left").select(F.col("c").alias("node_id"), root, depth, F.lit(False).alias("on_cycle"))
        work.write(raked, f"done/step={2 * n}")
        done = spark.read.schema(columns).parquet(work.path("done")).select("node_id", "root_id", "depth", "on_cycle")

    parents = df.select(F.col(parent).cast("string").alias("node_id")).where("node_id is not null").distinct()
    children = (states[0] if states else state).select(F.col("c").alias("node_id"))
    top = parents.join(children, "node_id", "left_anti")
    return done.unionByName(top.select("node_id", F.col("node_id").alias("root_id"), F.lit(0).alias("depth"), F.lit(False).alias("on_cycle")))


def paths(df: DataFrame, child: str, parent: str, resolved: DataFrame) -> DataFrame:
    """(``node_id``, ``path``): the ids from the root down to each node of the trees in ``resolved``; nodes on or below cycles have none.

    Pointer doubling: every node holds its nearest 2^k ancestors and asks the
    farthest of them for as many more, so a depth takes its logarithm in rounds.
    The lists are the result itself, one of the node's depth for each node.
    """
    spark = df.sparkSession
    work = Scratch(spark, "paths")
    columns = "c string, far string, above array<string>"
    tree = resolved.where("depth >= 0").select("node_id", "depth")
    up = links(df, child, parent).join(tree.select(F.col("node_id").alias("c"), "depth"), "c")
    found = work.write(up.select("c", F.col("p").alias("far"), F.array("p").alias("above"), "depth"), "up0")
    k = 0
    while True:
        # Whose list is as long as its depth has its whole path; the others ask on, and are asked themselves.
        work.write(found.where(F.size("above") == F.col("depth")).select("c", "far", "above"), f"done/step={k}")
        done = spark.read.schema(columns).parquet(work.path("done")).select("c", "far", "above")
        open_ = found.where(F.size("above") < F.col("depth"))
        if open_.isEmpty():
            break
        asked = done.unionByName(open_.select("c", "far", "above")).select(F.col("c").alias("far"), F.col("far").alias("next"), F.col("above").alias("rest"))
        k += 1
        found = work.write(open_.join(asked, "far").select("c", F.col("next").alias("far"), F.concat("above", "rest").alias("above"), "depth"), f"up{k}")
    roots = tree.where("depth = 0").select("node_id", F.array("node_id").alias("path"))
    return roots.unionByName(done.select(F.col("c").alias("node_id"), F.concat(F.reverse("above"), F.array("c")).alias("path")))


def descendants(paths: DataFrame) -> DataFrame:
    """(``ancestor_id``, ``node_id``, ``distance``) of ``paths``: all nodes below each node, as rows, not as one list per node.

    As many rows as all paths have steps.  Filter the paths first to ask for the
    nodes below some only.
    """
    rows = paths.select("node_id", F.size("path").alias("__n"), F.posexplode("path").alias("at", "ancestor_id"))
    return rows.where("at < __n - 1").select("ancestor_id", "node_id", (F.col("__n") - 1 - F.col("at")).alias("distance"))
