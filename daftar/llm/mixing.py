"""Sources combined to target shares of all tokens.

Shares run down a tree of domain, language and source.  At each node the budget
is spread over the children by weight, none beyond what its texts give under
the allowed repetitions; what a child cannot take goes to its siblings, and
only what they cannot take either goes to the node above.  A leaf's tokens are
drawn from seeded epochs: whole epochs first, then the prefix of the next one's
random order that holds the rest.

The tree has one leaf per wanted source and language, so it is planned on the
driver; texts never are.  A prefix is found from token sums of hash slices, and
only the slice in which it ends is ordered text by text.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SLICES = 4096
Leaf = tuple[str, str, str]


def domain_of(source: str) -> str:
    """The domain of a source: its name before the last part."""
    return source.rpartition("_")[0] or source


def spread(budget: float, weights: dict, caps: dict) -> dict:
    """Budget over keys by weight, none beyond its cap; the excess goes to the others by weight again."""
    out, open_ = dict.fromkeys(weights, 0.0), {k for k in weights if weights[k] > 0 and caps[k] > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in open_)
        full = [k for k in sorted(open_) if out[k] + left * weights[k] / total >= caps[k]]
        if not full:
            for k in open_:
                out[k] += left * weights[k] / total
            break
        for k in full:
            left -= caps[k] - out[k]
            out[k] = caps[k]
        open_.difference_update(full)
    return out


def budgets(leaves: dict[Leaf, tuple[float, int]], targets: dict[str, tuple[float, int]], total: float | None) -> dict[Leaf, float]:
    """Tokens to take of each leaf.

    ``leaves``: (domain, language, source) to (tokens, texts); ``targets``:
    source to (share, repetitions allowed).  Without ``total`` it is the
    largest at which every wanted source that has texts reaches its share.
    """
    of_source: dict[str, float] = defaultdict(float)
    for (_, _, s), (n, _) in leaves.items():
        of_source[s] += n
    leaves = {k: v for k, v in leaves.items() if k[2] in targets and v[0] > 0}
    present = {k[2] for k in leaves}
    caps = {k: v[0] * targets[k[2]][1] for k, v in leaves.items()}
    weight = {k: targets[k[2]][0] * v[0] / of_source[k[2]] for k, v in leaves.items()}
    # A source without texts leaves its share to its domain first.
    lost: dict[str, float] = defaultdict(float)
    for s, (share, _) in targets.items():
        if s not in present:
            lost[domain_of(s)] += share
    for d, share in lost.items():
        kin = [k for k in weight if k[0] == d] or list(weight)
        own = sum(weight[k] for k in kin)
        for k in kin:
            weight[k] += share * weight[k] / own if own else 0.0
    if total is None:
        ratios = [caps[k] / weight[k] for k in weight if weight[k] > 0]
        total = min(ratios) * sum(weight.values()) if ratios else 0.0

    def below(keys: list[Leaf], depth: int, budget: float) -> dict[Leaf, float]:
        if depth == 3:
            return {keys[0]: budget}
        parts: dict[str, list[Leaf]] = defaultdict(list)
        for k in keys:
            parts[k[depth]].append(k)
        given = spread(budget, {p: sum(weight[k] for k in ks) for p, ks in parts.items()}, {p: sum(caps[k] for k in ks) for p, ks in parts.items()})
        return {k: v for p, ks in parts.items() for k, v in below(ks, depth + 1, given[p]).items()}

    return below(list(leaves), 0, total) if leaves else {}


def draw(texts: DataFrame, wanted: dict[Leaf, float], seed: int) -> DataFrame:
    """(doc_id, source, lang, domain, epoch, n_tokens): the drawn texts, once per epoch (from 0).

    ``texts`` has doc_id, domain, lang, source and n_tokens.
    """
    spark = texts.sparkSession
    leaf = ["domain", "lang", "source"]
    plan = spark.createDataFrame([(*k, float(v)) for k, v in wanted.items()], "domain string, lang string, source string, budget double")
    held = texts.groupBy(*leaf).agg(F.sum("n_tokens").alias("held"))
    plan = held.join(F.broadcast(plan), leaf).where("held > 0").withColumn("whole", F.floor(F.col("budget") / F.col("held") + 1e-9).cast("int"))
    plan = plan.withColumn("rest", F.greatest(F.col("budget") - F.col("whole") * F.col("held"), F.lit(0.0))).select(*leaf, "whole", "rest")
    t = texts.join(F.broadcast(plan), leaf)  # one row per wanted source and language
    t = t.withColumn("__h", F.xxhash64(F.lit(seed), "whole", "doc_id")).withColumn("__slice", F.pmod("__h", F.lit(SLICES)).cast("int"))
    # The last, partial epoch: tokens of each slice of its random order, then of the texts in the slice where it ends.
    sums = t.groupBy(*leaf, "__slice", "rest").agg(F.sum("n_tokens").alias("n"))
    up_to = F.sum("n").over(W.partitionBy(*leaf).orderBy("__slice"))
    sums = sums.select(*leaf, "__slice", "rest", (up_to - F.col("n")).alias("before"), up_to.alias("after"))
    inside = sums.where("before < rest").withColumn("ends", F.col("after") > F.col("rest")).select(*leaf, "__slice", "before", "ends")
    some = t.join(inside, [*leaf, "__slice"])
    running = F.sum("n_tokens").over(W.partitionBy(*leaf, "__slice").orderBy("__h", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    last = some.where("ends").withColumn("__sum", F.col("before") + running)
    # The text in which the prefix ends is taken if that comes nearer to the budget.
    last = last.where(F.col("__sum") - F.col("n_tokens") / 2 <= F.col("rest"))
    cols = ["doc_id", *leaf, "n_tokens"]
    partial = some.where("not ends").select(*cols, "whole").unionByName(last.select(*cols, "whole"))
    full = t.where("whole > 0").select(*cols, F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"))
    return full.unionByName(partial.withColumnRenamed("whole", "epoch"))


def held(texts: DataFrame, targets: DataFrame) -> float:
    """Tokens of all texts that ``mix`` may draw, each once."""
    wanted = targets.where("source is not null").select("source").distinct()
    t = texts.where("doc_id is not null").join(F.broadcast(wanted), "source", "left_semi")
    return float(t.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0)


def mix(texts: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 20) -> tuple[DataFrame, dict[Leaf, float]]:
    """The drawn texts and the budget of each leaf.

    ``texts`` has doc_id, source, lang and n_tokens (a null language is ``und``,
    rows of null id or source are left out); ``targets`` source, target_share
    and max_repeats (repeated rows count once, the larger share holds).
    """
    aim = {r["source"]: (float(r["s"] or 0), int(r["m"] or 0)) for r in targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("m")).collect()}
    names = texts.sparkSession.createDataFrame([(s, domain_of(s)) for s in aim], "source string, domain string")
    t = texts.where("doc_id is not null and n_tokens > 0").join(F.broadcast(names), "source").select("doc_id", "domain", F.coalesce("lang", F.lit("und")).alias("lang"), "source", "n_tokens")
    leaves = {(r["domain"], r["lang"], r["source"]): (float(r["n"]), r["k"]) for r in t.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k")).collect()}
    wanted = budgets(leaves, aim, total)
    return draw(t, wanted, seed), wanted
