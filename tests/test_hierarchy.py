import random

from daftar.operators import hierarchy


def brute(links):
    parent = {}
    for c, p in links:
        if c is not None and p is not None:
            parent[c] = min(p, parent.get(c, p))
    out = {}
    for n in set(parent) | {p for _, p in links if p is not None}:
        seen = [n]
        while seen[-1] in parent and parent[seen[-1]] not in seen:
            seen.append(parent[seen[-1]])
        if seen[-1] in parent:
            ring = seen[seen.index(parent[seen[-1]]) :]
            out[n] = (min(ring), -1, None, n in ring)
        else:
            out[n] = (seen[-1], len(seen) - 1, seen[::-1], False)
    return out


def resolved(spark, links):
    df = spark.createDataFrame(links, "c string, p string")
    found = hierarchy.resolve(df, "c", "p")
    path = {r["node_id"]: r["path"] for r in hierarchy.paths(df, "c", "p", found).collect()}
    return {r["node_id"]: (r["root_id"], r["depth"], path.get(r["node_id"]), r["on_cycle"]) for r in found.collect()}


def test_random_forests_with_cycles(spark):
    rng = random.Random(4)
    ids = [f"n{i:03d}" for i in range(120)]
    links = [(ids[i], ids[rng.randrange(max(1, i - 5), i + 1)]) for i in range(1, 90)]  # chains, and loops of one
    links += [("n100", "n101"), ("n101", "n102"), ("n102", "n100"), ("n103", "n102"), ("n104", "n103"), ("n110", "n111"), ("n111", "n110")]
    links += [("n112", "n112"), ("n113", "n112"), ("n005", "n001"), (None, "n001"), (None, "n119"), ("n115", None)]
    assert resolved(spark, links + links[:20]) == brute(links)


def test_long_chain_and_star(spark):
    links = [(f"a{i:03d}", f"a{i + 1:03d}") for i in range(70)] + [(f"b{i:03d}", "hub") for i in range(200)]
    got = resolved(spark, links)
    assert got == brute(links)
    assert got["a000"][1] == 70


def test_empty(spark):
    assert resolved(spark, []) == {}


def test_descendants(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("x", "x")], "c string, p string")
    got = {(r["ancestor_id"], r["node_id"], r["distance"]) for r in hierarchy.descendants(hierarchy.paths(df, "c", "p", hierarchy.resolve(df, "c", "p"))).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)}


def test_other_parents(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "c"), ("a", "b"), ("d", "b"), ("d", None), (None, "b"), ("e", "e"), ("e", "d")], "c string, p string")
    assert sorted(tuple(r) for r in hierarchy.other_parents(df, "c", "p").collect()) == [("a", "c"), ("e", "e")]


def test_chain_of_many(spark):
    """A chain and a ring far deeper than any list should be."""
    n = 4_000
    df = spark.range(n - 1).selectExpr("format_string('%06d', id + 1) c", "format_string('%06d', id) p").union(spark.range(n).selectExpr("format_string('r%06d', id) c", "format_string('r%06d', (id + 1) % 4000) p"))
    out = hierarchy.resolve(df, "c", "p")
    assert out.where("root_id = '000000' and depth = cast(node_id as int) and not on_cycle").count() == n
    assert out.where("root_id = 'r000000' and depth = -1 and on_cycle").count() == n
