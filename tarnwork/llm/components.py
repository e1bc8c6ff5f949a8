"""Connected components of a table of links, by contraction.

Each round every node hooks onto the neighbour (or itself) with the least hash, links
are redrawn between the nodes so chosen, and those inside one node vanish.  The
hashes change with the round, so the links shrink by a constant factor on average,
also on long paths.  Nothing is collected; each round is written to the shared folder.
"""

from functools import reduce

from pyspark.sql import functions as F

from .common import stage


def components(links, most_rounds=60):
    """``links``: columns ``a``, ``b`` (bigint).  Returns ``node``, ``root``: a row for each
    node with a link to another node; equal roots mean the same component."""
    edges = stage(links.filter("a is not null and b is not null and a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    hooks = []
    for r in range(most_rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(r), c).alias("h"), c.alias("id"))
        chosen = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("best")).select(F.col("a").alias("node"), F.least("best", rank(F.col("a"))).getField("id").alias("to"))
        hook = stage(chosen, "hooks")
        hooks.append(hook)
        left = edges.join(hook.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(hook.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        edges = stage(left.filter("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def follow(labels, hook):
        to = hook.select(F.col("node").alias("root"), "to")
        return stage(labels.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")

    return reduce(follow, hooks[1:], hooks[0].select("node", F.col("to").alias("root")))
