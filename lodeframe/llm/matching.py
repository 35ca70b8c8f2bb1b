"""One-to-one matching of two sides by loopy belief propagation on candidate pairs."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize


def belief_propagation(edges: DataFrame, left: str, right: str, logit: str, rounds: int = 200, tol: float = 1e-3, cut_every: int = 3) -> DataFrame:
    """Marginal match probabilities of candidate pairs under one-to-one factors.

    ``edges`` has distinct pairs with their log-odds by attributes alone. Each pair
    is a binary variable; each node is a factor that allows at most one of its pairs
    to be a match. Messages pass between pairs and nodes by aggregating at a node
    and joining back until no message changes by more than ``tol``; the model has one
    fixed point on any graph. A warning is given and ``converged`` is false should ``rounds`` not do.
    A pair whose two nodes have no other pair is settled at once. A node may have any
    number of pairs: sums are taken with partial aggregates, and no list of a node's
    pairs is ever built. Nodes without pairs aren't in the result; no pairs give an
    empty result. Adds ``p``, ``rounds_run`` and ``converged``.
    """
    w = F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(logit))))
    # nodes travel as two hashes, 96 bits, not as the strings that they may be
    ids = {f"_{c}{i}": f(F.col(n).cast("string")) for c, n in (("l", left), ("r", right)) for i, f in enumerate((F.xxhash64, F.hash))}
    all_edges = materialize(edges.withColumns(ids), "edges")
    cur = all_edges.select(*ids, w.alias("_w"))
    sides = {"_l": ["_l0", "_l1"], "_r": ["_r0", "_r1"]}
    for name, key in sides.items():
        several = materialize(cur.groupBy(*key).agg(F.lit(True).alias(name), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "several")
        cur = cur.join(broadcast_if_small(several, limit=2 << 20), key, "left")
    one = F.lit(1.0)
    cur = materialize(cur.withColumns({"_a": one, "_b": one}), "bp")
    lone = cur.where("_l is null and _r is null").drop("_l", "_r")
    cur = cur.where("_l or _r").drop("_l", "_r")

    def passed(cur: DataFrame, key: list[str], sent: str) -> tuple[DataFrame, Column]:
        """The pairs with the sum at their node, and the message that leaves each pair out."""
        s = cur.groupBy(*key).agg(F.sum(F.col("_w") * F.col(sent)).alias("_s"))
        return cur.join(s.hint("shuffle_hash"), key), 1 / (1 + F.greatest(F.lit(0.0), F.col("_s") - F.col("_w") * F.col(sent)))

    done, change = 0, None
    while done < rounds:
        for _ in range(min(cut_every, rounds - done)):
            cur, a = passed(cur, sides["_l"], "_b")
            cur, b = passed(cur.withColumn("_a", a).drop("_s"), sides["_r"], "_a")
            last = cur.withColumn("_old", F.col("_b")).withColumn("_b", b).drop("_s")
            cur = last.drop("_old")
            done += 1
        last = materialize(last, "bp")
        change = last.agg(F.max(F.abs(F.col("_b") - F.col("_old")))).first()[0]
        cur = last.drop("_old")
        if change is None or change <= tol:
            break
    converged = change is None or change <= tol
    if not converged:
        warnings.warn(f"messages still change by {change} after {done} rounds", stacklevel=2)
    x = F.col("_w") * F.col("_a") * F.col("_b")
    out = cur.withColumn("rounds_run", F.lit(done)).withColumn("converged", F.lit(converged))
    out = out.unionByName(lone.withColumn("rounds_run", F.lit(0)).withColumn("converged", F.lit(True)))
    out = out.select(*ids, (x / (1 + x)).alias("p"), "rounds_run", "converged")
    return all_edges.join(out, list(ids)).drop(*ids)
