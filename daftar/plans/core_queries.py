"""Queries of the general problems (order hierarchies, dates) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.operators import hierarchy, timestamps
from daftar.session import Scratch, table


def supersedes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gr_edges").select("src_id", "dst_id", "kind").where(F.lower(F.trim("kind")) == "supersedes")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.resolve(supersedes(spark, d), "src_id", "dst_id")
    return found.select(F.col("node_id").alias("doc_id"), "root_id", "depth")


def _paths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    work, links = Scratch(spark, "orders"), supersedes(spark, d)
    found = work.write(hierarchy.resolve(links, "src_id", "dst_id"), "resolved")
    return found, hierarchy.paths(links, "src_id", "dst_id", found)


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Each order with its path from the root, and how many later orders stand below it."""
    found, paths = _paths(spark, d)
    below = hierarchy.descendants(paths).groupBy(F.col("ancestor_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_below"))
    return found.join(paths, "node_id", "left").join(below, "node_id", "left").select(
        F.col("node_id").alias("doc_id"), "root_id", "depth", F.array_join("path", " > ").alias("path"),
        F.coalesce("n_below", F.lit(0).cast("long")).alias("n_below"), "on_cycle",
    )


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_paths(spark, d)[1])


def p4_other_parents(spark: SparkSession, d: str) -> DataFrame:
    """Links to a second parent, which no tree can hold."""
    return hierarchy.other_parents(supersedes(spark, d), "src_id", "dst_id")


def _date_values(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "gr_documents").select(F.lit("gr_documents").alias("tbl"), F.col("doc_id").alias("row_key"), F.col("date").alias("value"))
    edges = table(spark, d, "gr_edges").select(F.lit("gr_edges").alias("tbl"), F.col("edge_id").cast("string").alias("row_key"), F.col("dst_date").alias("value"))
    return docs.unionByName(edges).where(F.col("value").isNotNull())


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    values = _date_values(spark, d).where(~F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}\z"))
    return timestamps.normalise(values, "value").where(F.col("normal_form").isNotNull()).select("tbl", "row_key", "normal_form").distinct()


def p6_status(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each table were read, and in which way."""
    out = timestamps.normalise(_date_values(spark, d), "value")
    return out.groupBy("tbl", F.coalesce("time_status", F.lit("no date")).alias("time_status")).agg(F.count(F.lit(1)).alias("n_values"))


QUERIES = {
    "p4_found": p4_found,
    "p4_hierarchy": p4_hierarchy,
    "p4_descendants": p4_descendants,
    "p4_other_parents": p4_other_parents,
    "p6_found": p6_found,
    "p6_status": p6_status,
}

_TREE = """
WITH RECURSIVE e AS (
  SELECT src_id AS c, min(dst_id) AS p FROM gr_edges
  WHERE lower(trim(kind)) = 'supersedes' AND src_id IS NOT NULL AND dst_id IS NOT NULL GROUP BY src_id),
n AS (SELECT c AS id FROM e UNION SELECT dst_id FROM gr_edges WHERE lower(trim(kind)) = 'supersedes' AND dst_id IS NOT NULL),
walk AS (
  SELECT id, id AS cur, [id] AS seen, FALSE AS closed FROM n
  UNION ALL
  SELECT w.id, e.p, list_append(w.seen, e.p), list_contains(w.seen, e.p) FROM walk w JOIN e ON e.c = w.cur WHERE NOT w.closed),
top AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(seen) DESC) = 1),
res AS (
  SELECT id AS doc_id,
    CASE WHEN closed THEN list_min(list_slice(seen, list_position(seen, cur), len(seen))) ELSE cur END AS root_id,
    CASE WHEN closed THEN -1 ELSE len(seen) - 1 END AS depth,
    CASE WHEN NOT closed THEN list_reverse(seen) END AS path,
    closed AND list_position(seen, cur) = 1 AS on_cycle
  FROM top)
"""

ORACLE = {
    "p4_found": _TREE + "SELECT doc_id, root_id, depth::INT AS depth FROM res",
    "p4_hierarchy": _TREE
    + """, below AS (SELECT a AS doc_id, count(*) AS n_below FROM (SELECT unnest(path[1:len(path) - 1]) AS a FROM res WHERE path IS NOT NULL) GROUP BY a)
SELECT r.doc_id, root_id, depth::INT AS depth, array_to_string(path, ' > ') AS path, coalesce(n_below, 0) AS n_below, on_cycle
FROM res r LEFT JOIN below b ON r.doc_id = b.doc_id""",
    "p4_other_parents": """SELECT DISTINCT src_id AS node_id, dst_id AS parent_id FROM (SELECT *, min(dst_id) OVER (PARTITION BY src_id) AS low FROM gr_edges
        WHERE lower(trim(kind)) = 'supersedes' AND src_id IS NOT NULL AND dst_id IS NOT NULL) WHERE dst_id <> low""",
    "p4_descendants": _TREE
    + """, x AS (SELECT doc_id AS node_id, depth, path, unnest(range(len(path))) AS cur FROM res WHERE path IS NOT NULL)
SELECT path[cur + 1] AS ancestor_id, node_id, (depth - cur)::INT AS distance FROM x WHERE cur < depth""",
}
