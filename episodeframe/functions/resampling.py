"""Exact resampling with replacement: each round's draws are dealt to blocks of rows, then to rows, by binomial splits.

A round draws exactly as many rows as there are. How many fall into the left half of some blocks is a binomial
draw, seeded by the two ends of the stretch that is split: every task that needs a split draws it alike, and walks
down to its own blocks without knowing any other's rows. What a task sends is one row a round, the sums of what it drew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct rows that a block has, about; the blocks' sizes (one number each) are what every task knows.
BLOCK = 4096
#: Rows among which draws are dealt in one step.
LEAF = 64


def block_draws(sizes: np.ndarray, block: int, n: int, rounds: int, seed: int) -> np.ndarray:
    """How many of each round's n draws fall into a block, along the path from all blocks to it."""
    low, high, counts = 0, len(sizes), np.full(rounds, n)
    while high - low > 1:
        middle = (low + high) // 2
        left, whole = sizes[low:middle].sum(), sizes[low:high].sum()
        drawn = np.random.default_rng([seed, low, high]).binomial(counts, left / whole if whole else 0.0)
        if block < middle:
            high, counts = middle, drawn
        else:
            low, counts = middle, counts - drawn
    return counts


def dealt(counts: np.ndarray, weights: np.ndarray, rng: np.random.Generator, at: int = 0) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows, draws of each by round) for a block's rows, LEAF at most at a time."""
    if len(weights) <= LEAF:
        yield slice(at, at + len(weights)), rng.multinomial(counts, weights / weights.sum())
        return
    half = len(weights) // 2
    left = rng.binomial(counts, weights[:half].sum() / weights.sum())
    yield from dealt(left, weights[:half], rng, at)
    yield from dealt(counts - left, weights[half:], rng, at + half)


def resampled(units: DataFrame, rounds: int, seed: int, sums: tuple[str, ...] = (), rates: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """(round, drawn, sums..., rates...) of `rounds` resamplings of units (unit, copies, ...), a distinct row and how often it stands.

    `drawn` is exactly the number of rows, copies counted, in every round. A column of `sums` is added up over what a round draws;
    for name: (n, wins) of `rates`, every drawn unit draws n outcomes again, each a win at wins / n, and `name` is the number of wins.
    The same units give the same draws, however they are partitioned. Without units there are no rounds.
    """
    rates = rates or {}
    facts = units.agg(F.count(F.lit(1)).alias("units"), F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()
    if not facts.n:
        return units.sparkSession.createDataFrame([], "round long, drawn long" + "".join(f", {c} double" for c in sums) + "".join(f", {c} long" for c in rates))
    blocks = -(-facts.units // BLOCK)
    keyed = units.withColumn("block", F.pmod(F.xxhash64("unit"), F.lit(blocks)).cast("int"))
    sizes = np.zeros(blocks, np.int64)
    for r in keyed.groupBy("block").agg(F.sum("copies").alias("n")).collect():  # a number for every BLOCK rows
        sizes[r.block] = r.n
    total = int(facts.n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = {"drawn": np.zeros(rounds, np.int64), **{c: np.zeros(rounds) for c in sums}, **{c: np.zeros(rounds, np.int64) for c in rates}}
        seen = False

        def draw(rows: pd.DataFrame) -> None:
            block = int(rows["block"].iloc[0])
            rng = np.random.default_rng([seed, block, blocks, 1])
            values = {c: rows[c].to_numpy() for c in {*sums, *(x for pair in rates.values() for x in pair)}}
            for at, times in dealt(block_draws(sizes, block, total, rounds, seed), rows["copies"].to_numpy().astype(float), rng):
                out["drawn"] += times.sum(axis=1)
                for c in sums:
                    out[c] += times @ values[c][at]
                for c, (n, wins) in rates.items():
                    size = values[n][at].astype(np.int64)
                    out[c] += rng.binomial(times * size, np.where(size > 0, values[wins][at] / np.maximum(size, 1), 0)).sum(axis=1)

        held: list[pd.DataFrame] = []
        for b in batches:
            for block, rows in b.groupby("block", sort=False):
                seen = True
                if held and held[0]["block"].iloc[0] != block:
                    draw(pd.concat(held))
                    held = []
                held.append(rows)
        if held:
            draw(pd.concat(held))
        if seen:
            yield pd.DataFrame({"round": np.arange(rounds), **out})

    kinds = {"drawn": "long", **dict.fromkeys(sums, "double"), **dict.fromkeys(rates, "long")}
    parts = keyed.repartition("block").sortWithinPartitions("block", "unit").mapInPandas(run, "round long, " + ", ".join(f"{c} {k}" for c, k in kinds.items()))
    return parts.groupBy("round").agg(*(F.sum(c).alias(c) for c in kinds))


def resampled_means(rows: DataFrame, value: str, rounds: int, seed: int, less: str | None = None) -> DataFrame:
    """(round, drawn, mean) of the values that are not null; with `less`, of value - less. Equal values are one unit."""
    v = F.col(value) - F.col(less) if less else F.col(value)
    # -0.0 and 0.0 are one value, and a value's name is the same wherever it lies
    values = rows.select((v.cast("double") + F.lit(0.0)).alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("copies"))
    found = resampled(values.withColumn("unit", F.col("v").cast("string")), rounds, seed, ("v",))
    return found.select("round", "drawn", (F.col("v") / F.col("drawn")).alias("mean"))
