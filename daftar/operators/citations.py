"""The citation graph: edges from printed references, their reading and walks over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from daftar.functions.text import canonical_number
from daftar.operators.search import best, containing
from daftar.session import Scratch


def latest(docs: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ("ingested_at", "title")) -> DataFrame:
    """One row per key: the last taken in. Aggregation keeps it free of hot groups; rows with a null key are left out."""
    rest = [c for c in docs.columns if c not in (key, *order)]
    row = F.struct(*order, *rest)
    picked = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("r"))
    return picked.select(key, *[F.col(f"r.{c}").alias(c) for c in docs.columns if c != key])


BROADCAST_ROWS = 1_000_000  # rows of an id and a place in a file, some 100 bytes each, up to which they are broadcast


def latest_in_place(docs: DataFrame, key: str, at: str, order: tuple[str, ...] = ("ingested_at", "title")) -> DataFrame:
    """``latest`` for rows with long texts: the rows stay where they lie.

    ``at`` names a column that tells rows apart (as file and place in it).  What
    is not the last of its key is found on the narrow columns alone and taken
    out by an anti-join; it is broadcast after a count, beyond
    ``BROADCAST_ROWS`` joined by shuffle.
    """
    narrow = docs.where(F.col(key).isNotNull()).select(key, *order, at)
    best = narrow.groupBy(key).agg(F.max_by(at, F.struct(*order, at)).alias("__best"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    rest = narrow.select(key, at).join(best, key).where(F.col(at) != F.col("__best")).select(at)
    rest = Scratch(docs.sparkSession, "latest").write(rest, "rest")
    few = rest.count() <= BROADCAST_ROWS
    return docs.where(F.col(key).isNotNull()).join(F.broadcast(rest) if few else rest, at, "left_anti").drop(at)


def build_edges(docs: DataFrame, progress: Callable[[str], None] | None = None) -> DataFrame:
    """(src_id, dst_id, dst_number, dst_canon, kind, resolution, dst_date, by_date) of ``docs`` (doc_id, gr_number, date, refs, supersedes).

    Per document a canonical number counts once, in its first printed form.  It
    is dangling if no other document has it, resolved if one does, and also if
    several do but one alone has the cited date; else ambiguous.  A number that
    only the document itself has gives no edge.  ``progress`` is told each step
    as it is planned.
    """
    tell = progress or (lambda step: None)
    tell("references")
    targets = docs.select(F.col("doc_id").alias("t_id"), canonical_number(F.col("gr_number")).alias("dst_canon"), F.col("date").alias("t_date")).where("dst_canon is not null")
    refs = docs.select("doc_id", "supersedes", F.posexplode("refs").alias("pos", "ref")).select(
        F.col("doc_id").alias("src_id"), "supersedes", "pos", F.col("ref.number").alias("dst_number"), F.col("ref.date").alias("dst_date"), canonical_number(F.col("ref.number")).alias("dst_canon")
    ).where("dst_canon is not null")
    first = refs.groupBy("src_id", "dst_canon").agg(F.min_by(F.struct("supersedes", "dst_number", "dst_date"), "pos").alias("r")).select("src_id", "dst_canon", "r.*")
    # Candidates are summed up per number before the join, so a number cited by a third of all rows meets one row. The
    # smallest and the largest id give the other document where there is one other.
    few = lambda keys, n, lo, hi: targets.groupBy(*keys).agg(F.count(F.lit(1)).alias(n), F.min("t_id").alias(lo), F.max("t_id").alias(hi))
    tell("candidates")
    by_number = few(["dst_canon"], "n", "one", "top")
    by_day = few(["dst_canon", "t_date"], "n_day", "day_one", "day_top").where("t_date is not null").withColumnRenamed("t_date", "dst_date")
    own = targets.select(F.col("t_id").alias("src_id"), "dst_canon", F.col("t_date").alias("own_date"), F.lit(True).alias("own"))
    e = first.join(by_number, "dst_canon", "left").join(by_day, ["dst_canon", "dst_date"], "left").join(own, ["src_id", "dst_canon"], "left")
    is_own = F.coalesce("own", F.lit(False))
    others = F.coalesce("n", F.lit(0)) - is_own.cast("int")
    same_day = F.coalesce("n_day", F.lit(0)) - F.coalesce((is_own & (F.col("own_date") == F.col("dst_date"))).cast("int"), F.lit(0))
    e = e.withColumn("others", others).withColumn("same_day", same_day).where(~((F.col("others") == 0) & is_own))
    other = F.when(F.col("one") != F.col("src_id"), F.col("one")).otherwise(F.col("top"))
    day_other = F.when(F.col("day_one") != F.col("src_id"), F.col("day_one")).otherwise(F.col("day_top"))
    tell("edges")
    by_date = (F.col("others") > 1) & (F.col("same_day") == 1)
    return e.select(
        "src_id",
        F.when(F.col("others") == 1, other).when(by_date, day_other).alias("dst_id"),
        "dst_number", "dst_canon",
        F.when(F.coalesce("supersedes", F.lit(False)), "supersedes").otherwise("cites").alias("kind"),
        F.when(F.col("others") == 0, "dangling").when((F.col("others") == 1) | by_date, "resolved").otherwise("ambiguous").alias("resolution"),
        "dst_date", by_date.alias("by_date"),
    )


def counts(edges: DataFrame) -> DataFrame:
    n = lambda c, a: F.count(F.when(c, 1)).alias(a)
    r = F.col("resolution")
    return edges.agg(
        F.count(F.lit(1)).alias("edges"), n(r == "resolved", "resolved"), n(F.col("by_date"), "resolved_by_date"), n(r == "dangling", "dangling"),
        n(r == "ambiguous", "ambiguous"), n(F.col("kind") == "supersedes", "supersedes"),
    )


def stored_edges(edges: DataFrame) -> DataFrame:
    """The stored edges once each, ``kind`` in one spelling."""
    kind = F.lower(F.trim("kind"))
    return edges.select("src_id", "dst_id", "dst_number", "dst_canon", kind.alias("kind"), "resolution", "dst_date").distinct()


def chains(docs: DataFrame, edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """(doc_id, hop, next_id): for every superseded order the orders that replaced it, the last one in force.

    At each order the newest superseder not yet in the chain is followed, by
    (date, id); at most ``max_depth`` hops.  A chain has at most ``max_depth``
    + 1 orders, so of an order's superseders only as many of the newest can ever
    be followed, and only those are kept, however many there are.  A round
    extends all chains at once by a join.
    """
    dated = docs.select(F.col("doc_id").alias("src_id"), F.coalesce("date", F.lit("")).alias("date"))
    claims = edges.where("kind = 'supersedes' and dst_id is not null").select(F.col("dst_id").alias("at"), "src_id").distinct().join(dated, "src_id")
    work = Scratch(docs.sparkSession, "chains")
    newest = best(claims, ["at"], [F.desc("date"), F.desc("src_id")], max_depth + 1)
    cands = work.write(newest.groupBy("at").agg(F.sort_array(F.collect_list(F.struct("date", "src_id")), asc=False).alias("cands")), "cands")
    known = docs.select(F.col("doc_id").alias("at"))
    front = cands.join(known, "at", "left_semi").select(F.col("at").alias("doc_id"), "at", F.array("at").alias("seen"))
    out = None
    for hop in range(1, max_depth + 1):
        nxt = F.get(F.filter("cands", lambda c: ~F.array_contains("seen", c["src_id"])), F.lit(0))["src_id"]
        step = front.join(cands, "at").select("doc_id", nxt.alias("at"), "seen").where("at is not null")
        step = work.write(step.select("doc_id", "at", F.concat("seen", F.array("at")).alias("seen")), f"hop{hop}")
        if step.limit(1).count() == 0:
            break
        found = step.select("doc_id", F.lit(hop).alias("hop"), F.col("at").alias("next_id"))
        out = found if out is None else out.unionByName(found)
        front = step
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id string, hop int, next_id string")


def neighbourhood(edges: DataFrame, roots: DataFrame, depth: int, max_nodes: int = 60) -> DataFrame:
    """(root_id, node_id, distance): orders within ``depth`` undirected links of each root, nearest first up to ``max_nodes``.

    Ties at the cap go to outgoing before incoming links, then to the smaller id.
    """
    known = edges.where("dst_id is not null").select("src_id", "dst_id").distinct()
    links = known.select(F.col("src_id").alias("at"), F.col("dst_id").alias("to"), F.lit(0).alias("way")).unionByName(known.select(F.col("dst_id").alias("at"), F.col("src_id").alias("to"), F.lit(1).alias("way")))
    links = links.where("at <> to").groupBy("at", "to").agg(F.min("way").alias("way"))
    # At most max_nodes are reached and as many may be new, so of a hub's links only the first 2 x max_nodes can count.
    links = best(links, ["at"], ["way", "to"], 2 * max_nodes).select("at", "to", F.col("way").alias("w"))
    reached = roots.select("root_id", F.col("root_id").alias("node_id"), F.lit(0).alias("distance"), F.lit(0).alias("way"))
    for d in range(1, depth + 1):
        step = reached.where(F.col("distance") == d - 1).join(links, F.col("node_id") == F.col("at")).select("root_id", F.col("to").alias("node_id"), F.lit(d).alias("distance"), F.col("w").alias("way"))
        step = step.groupBy("root_id", "node_id", "distance").agg(F.min("way").alias("way"))
        new = step.join(reached.select("root_id", "node_id"), ["root_id", "node_id"], "left_anti")
        # What the cap leaves out is farther than all that is kept, so nothing beyond it can come in again.
        reached = best(reached.unionByName(new), ["root_id"], ["distance", "way", "node_id"], max_nodes).drop("rank")
    return reached.select("root_id", "node_id", "distance")


def warnings(docs: DataFrame, chain: DataFrame) -> DataFrame:
    """(doc_id, warning) for every order that a chain shows replaced: the first and, if another, the last of it."""
    d = docs.select(F.col("doc_id").alias("next_id"), "gr_number", F.coalesce("date", F.lit("unknown date")).alias("date"))
    rows = chain.join(d, "next_id").groupBy("doc_id").agg(
        F.max("hop").alias("hops"), F.min_by(F.struct("gr_number", "date"), "hop").alias("first"), F.max_by(F.struct("gr_number", "date"), "hop").alias("last")
    )
    own = docs.select("doc_id", F.col("gr_number").alias("own")).where("own is not null")
    name = lambda s: F.concat(F.coalesce(F.col(f"{s}.gr_number"), F.lit("?")), F.lit(" ("), F.col(f"{s}.date"), F.lit(")"))
    text = F.when(F.col("hops") > 1, F.concat(F.lit("Order "), "own", F.lit(" was replaced by "), name("first"), F.lit(", later by "), name("last"), F.lit(", the latest known.")))
    text = text.otherwise(F.concat(F.lit("Order "), "own", F.lit(" was replaced by "), name("first"), F.lit(".")))
    return rows.join(own, "doc_id").select("doc_id", text.alias("warning"))


def entries_from_json(raw: Column) -> Column:
    """References stored as JSON text, as (number, date) structs.

    Both stored shapes are read, a list of numbers and a list of objects; empty
    numbers and text that is no such list give none.
    """
    shape = "array<struct<number:string,date:string>>"
    objects = F.from_json(raw, shape)
    plain = F.transform(F.from_json(raw, "array<string>"), lambda x: F.struct(x.alias("number"), F.lit(None).cast("string").alias("date")))
    # A list of numbers read as objects gives nulls, a list of objects read as text gives their JSON.
    listed = F.when(F.ltrim(raw).rlike(r"^\[\s*\{"), objects).otherwise(plain)
    return F.coalesce(F.filter(listed, lambda r: F.coalesce(r["number"], F.lit("")) != ""), F.array().cast(shape))


def backfilled(docs: DataFrame) -> DataFrame:
    """``docs`` with ``gr_number_canon`` made where it is missing."""
    return docs.withColumn("gr_number_canon", F.coalesce("gr_number_canon", canonical_number(F.col("gr_number"))))


def claimed_by(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, doc_id): orders that declare a replacement and print a number which contains the asked one.

    The scan to use before edges are built.  Printed numbers are searched once
    each for all asked ones.
    """
    printed = docs.where("supersedes").select("doc_id", F.explode("refs").alias("r")).select("doc_id", F.col("r.number").alias("number")).where("number is not null").distinct()
    numbers = printed.select(F.col("number").alias("row_id"), F.col("number").alias("text")).distinct()
    met = containing(numbers, asked.select(F.col("asked").alias("pattern")))
    return printed.join(met, F.col("number") == F.col("row_id")).select(F.col("pattern").alias("asked"), "doc_id").distinct()


def arcs(nodes: DataFrame, per_arc: int = 7) -> DataFrame:
    """The newest ``per_arc`` nodes of each root and role, with ``place`` on the arc and ``hidden``, how many the arc leaves out.

    ``nodes`` has root_id, role, node_id and date.
    """
    w = W.partitionBy("root_id", "role")
    placed = nodes.withColumn("place", F.row_number().over(w.orderBy(F.desc_nulls_last("date"), "node_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    return placed.withColumn("hidden", F.greatest(F.col("n") - per_arc, F.lit(0))).where(F.col("place") <= per_arc).drop("n")


def reference_changes(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row: how many orders are read anew, how many have other references then, and the median length of their canonical numbers.

    Both have doc_id and refs.
    """
    canon = lambda c: F.array_sort(F.filter(F.transform(c, lambda r: canonical_number(r["number"])), lambda x: x.isNotNull()))
    both = stored.select("doc_id", canon("refs").alias("a")).join(parsed.select("doc_id", canon("refs").alias("b")), "doc_id")
    both = both.select(F.coalesce("a", F.array().cast("array<string>")).alias("a"), F.coalesce("b", F.array().cast("array<string>")).alias("b"))
    longest = F.explode_outer("b").alias("x")
    lengths = both.select(longest).agg(F.percentile(F.length("x"), F.lit(0.5)).alias("median_length"))
    return both.agg(F.count(F.lit(1)).alias("n_documents"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("n_changed")).crossJoin(lengths)  # one row each


def nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, gr_number, date, title, department): what a drawing says of an order; titles are cut to 120 characters."""
    return docs.select("doc_id", "gr_number", "date", F.substring(F.coalesce("title", F.lit("")), 1, 120).alias("title"), "department")


def outgoing(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """The edges from the asked orders (doc_id), resolved or not."""
    return edges.join(asked.select(F.col("doc_id").alias("src_id")).distinct(), "src_id", "left_semi")


def incoming(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """The edges to the asked orders (doc_id)."""
    return edges.join(asked.select(F.col("doc_id").alias("dst_id")).distinct(), "dst_id", "left_semi")


def neighbour_edges(edges: DataFrame, near: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(root_id, src, dst, kind) of the resolved edges within a neighbourhood, and (root_id, src_id, gr_number, date, kind, resolution) of what dangles from it.

    ``near`` is what ``neighbourhood`` gave.  Only nodes nearer than ``depth``
    are expanded: an edge needs such an end and both ends among the nodes, an
    unresolved reference such a source.
    """
    inner = near.where(F.col("distance") < depth).select("root_id", "node_id")
    solid = edges.where("resolution = 'resolved' and dst_id is not null").select("src_id", "dst_id", "kind").distinct()
    out = solid.join(inner, F.col("src_id") == F.col("node_id")).drop("node_id")
    into = solid.join(inner, F.col("dst_id") == F.col("node_id")).drop("node_id")
    touching = out.unionByName(into).distinct()
    inside = touching.join(near.select("root_id", F.col("node_id").alias("src_id")), ["root_id", "src_id"], "left_semi").join(near.select("root_id", F.col("node_id").alias("dst_id")), ["root_id", "dst_id"], "left_semi")
    loose = edges.where("resolution <> 'resolved' or dst_id is null").join(inner, F.col("src_id") == F.col("node_id"))
    ghosts = loose.select("root_id", "src_id", F.col("dst_number").alias("gr_number"), F.col("dst_date").alias("date"), "kind", "resolution").distinct()
    return inside.select("root_id", F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "kind"), ghosts


def supersession(docs: DataFrame, edges: DataFrame, chain: DataFrame, asked: DataFrame) -> DataFrame:
    """One row per asked id: doc_id, found, gr_number, declares, n_cites, n_held, superseded_by, chain.

    ``chain`` is what ``chains`` gave, of which ``superseded_by`` is the first
    and ``chain`` all orders.  An id that the register lacks is not found and
    says nothing else.
    """
    cites = outgoing(edges, asked).groupBy(F.col("src_id").alias("doc_id")).agg(F.countDistinct("dst_number").alias("n_cites"), F.countDistinct("dst_id").alias("n_held"))
    later = chain.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hop", "next_id"))), lambda x: x["next_id"]).alias("chain"))
    held = docs.select("doc_id", "gr_number", F.coalesce("supersedes", F.lit(False)).alias("declares"), F.lit(True).alias("found"))
    out = asked.select("doc_id").distinct().join(held, "doc_id", "left").join(cites, "doc_id", "left").join(later, "doc_id", "left")
    zero = lambda c: F.when(F.col("found"), F.coalesce(c, F.lit(0))).alias(c)
    return out.select("doc_id", F.coalesce("found", F.lit(False)).alias("found"), "gr_number", F.coalesce("declares", F.lit(False)).alias("declares"), zero("n_cites"), zero("n_held"), F.get("chain", F.lit(0)).alias("superseded_by"), "chain")


def held_numbers(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, doc_id): for each asked number the smallest id whose number contains it; null if none does.

    All asked numbers are searched in each distinct number once.
    """
    numbers = docs.where("gr_number is not null").groupBy("gr_number").agg(F.min("doc_id").alias("doc_id"))
    met = containing(numbers.select(F.col("gr_number").alias("row_id"), F.col("gr_number").alias("text")), asked.select(F.col("asked").alias("pattern")))
    first = met.join(numbers, F.col("row_id") == F.col("gr_number")).groupBy(F.col("pattern").alias("asked")).agg(F.min("doc_id").alias("doc_id"))
    return asked.select("asked").distinct().join(first, "asked", "left")


def departments_cited(blocks: DataFrame, names: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(department, n_documents, held) over reference blocks, and one row (n_documents, with_block, unattributed).

    ``blocks`` has doc_id and block (empty without one), ``names`` department
    and fragment, any of which in a block counts for the department; ``held``
    department, those the register has.
    """
    filled = blocks.where("block <> ''")
    met = containing(filled.select(F.col("doc_id").alias("row_id"), F.col("block").alias("text")), names.select(F.col("fragment").alias("pattern")))
    hits = met.join(names.select(F.col("fragment").alias("pattern"), "department").distinct(), "pattern").select(F.col("row_id").alias("doc_id"), "department").distinct()
    counted = hits.groupBy("department").agg(F.count(F.lit(1)).alias("n_documents")).join(held.select("department", F.lit(True).alias("held")).distinct(), "department", "left")
    named = blocks.select("doc_id", (F.col("block") != "").alias("has")).join(hits.select("doc_id", F.lit(True).alias("hit")).distinct(), "doc_id", "left")
    total = named.agg(F.count(F.lit(1)).alias("n_documents"), F.count(F.when(F.col("has"), 1)).alias("with_block"), F.count(F.when(F.col("has") & F.col("hit").isNull(), 1)).alias("unattributed"))
    return counted.withColumn("held", F.coalesce("held", F.lit(False))), total
