"""Expectation-maximisation over the votes of overlapping labelers, from counts of vote patterns.

Votes are 1, -1 or 0 (no opinion). Rows are first counted by pattern in Spark; with k labelers
there are at most 3^k patterns whatever the number of rows, so the iterations run on that table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rounds of the estimate; it stops earlier once nothing moves
ROUNDS = 100
#: how labelers are believed to vote (-1, 0, 1) on either class before anything is seen
BELIEF = {"good": (0.01, 0.49, 0.5), "bad": (0.5, 0.4, 0.1)}


def pattern(votes: list[Column]) -> Column:
    """One number per combination of votes, base three."""
    total = F.lit(0)
    for v in votes:
        total = total * 3 + v + 1
    return total.cast("int")


def count_patterns(rows: DataFrame, column: str) -> dict[int, int]:
    return {r[0]: r[1] for r in rows.groupBy(column).count().collect()}


def estimate(counts: dict[int, int], k: int, belief: float = 0.1) -> tuple[list[dict[str, list[float]]], float, dict[int, float]]:
    """(per labeler and class, the chance of a vote -1, 0, 1), positive share, posterior per pattern.

    Keeping silent is an outcome too, so labelers that only ever accuse or only ever approve are
    weighed rightly. The start is the balance of each pattern's votes, which also names the classes;
    pseudo-votes by ``BELIEF``, as many as ``belief`` of the rows, keep chances off 0 and the classes
    in place where labelers depend on each other.
    """
    votes = {p: [(p // 3 ** (k - 1 - i)) % 3 - 1 for i in range(k)] for p in counts}
    # one accusation outweighs the approvals: approvals are habitual
    post = {p: 1 / (1 + math.exp(-(sum(vs) if min(vs, default=0) >= 0 else -2.0 + 0.3 * sum(v for v in vs if v > 0)))) for p, vs in votes.items()}
    total, chance, share = sum(counts.values()), [], 0.5
    strength = 1 + belief * total
    for _ in range(ROUNDS):
        share = min(0.999, max(0.001, (sum(n * post[p] for p, n in counts.items()) + 1) / (total + 2)))
        chance = []
        for i in range(k):
            sides = {}
            for side in ("good", "bad"):
                seen = [strength * x for x in BELIEF[side]]
                for p, n in counts.items():
                    seen[votes[p][i] + 1] += n * (post[p] if side == "good" else 1 - post[p])
                sides[side] = [x / sum(seen) for x in seen]
            chance.append(sides)
        new = {}
        for p, vs in votes.items():
            odds = math.log(share / (1 - share)) + sum(math.log(c["good"][v + 1] / c["bad"][v + 1]) for v, c in zip(vs, chance))
            new[p] = 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))
        moved = max((abs(new[p] - post[p]) for p in new), default=0.0)
        post = new
        if moved < 1e-9:
            break
    return chance, share, post


def posterior(rows: DataFrame, column: str, post: dict[int, float], into: str) -> DataFrame:
    """Attach each row's posterior; the table has a row per pattern, at most 3^k."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(p, v) for p, v in post.items()] or [(-1, 0.5)], f"{column} int, {into} double")
    return rows.join(F.broadcast(known), column)
