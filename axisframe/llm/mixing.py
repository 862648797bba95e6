"""Mixing sources to target weights by Poisson replication.

A source's share of the output is its weight's share of all weights. Its repetition rate is what brings it there:
rate = total * weight share / its own size. Every document draws how often it occurs from a Poisson distribution with
that mean, by inverting the distribution function at a number hashed from the seed, its id and its text; so a draw needs
no state and any executor repeats it. Documents are exploded by their counts, and the copies are dealt out and ordered
by a second hash, which is a global shuffle.

Sources that ``weights`` doesn't name have weight ``default_weight``; at 0 they go. A null source is a source of its own.
Null and empty texts are documents like others. Rows that repeat draw alike, as they are the same document. Extra
columns are kept; those named ``copy`` or ``shuffle_key`` are replaced. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Terms of the distribution function that are inverted directly; beyond a mean of SPLIT a draw is the sum of several.
TERMS, SPLIT = 40, 8.0


def uniform(*parts: Column) -> Column:
    """A number from 0 to 1, of 52 bits, from the MD5 digest of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def thresholds(mean: Column) -> Column:
    """The distribution function at 0 to TERMS - 1; mean up to SPLIT. An array for each source, not for each document."""
    step = lambda acc, k: F.struct(
        (acc["p"] * mean / k).alias("p"),
        (acc["f"] + acc["p"] * mean / k).alias("f"),
        F.concat(acc["all"], F.array(acc["f"])).alias("all"),
    )
    first = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("f"), F.array().cast("array<double>").alias("all"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, step, lambda acc: acc["all"])


def poisson(at: Column, draw: Column) -> Column:
    """The smallest k for which the distribution function at k is over ``draw``: how many ``thresholds`` are not."""
    return F.size(F.filter(at, lambda f: f <= draw))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, total: float | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs``, each row as often as it is drawn, with ``copy`` (from 1) and ``shuffle_key``; ``total`` rows are aimed at (default: as many as there are)."""
    weights = weights or {}
    src = F.col(source_col)
    weight = F.lit(float(default_weight))
    for name, value in sorted(weights.items()):
        weight = F.when(F.col("__source") == F.lit(name), F.lit(float(value))).otherwise(weight)
    sizes = docs.groupBy(src.alias("__source")).agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.withColumn("__w", weight)
    sums = sizes.agg(F.sum("__w").alias("w"), F.sum("__n").alias("n")).first()
    all_w, all_n = float(sums["w"] or 0.0), float(sums["n"] or 0)
    goal = all_n if total is None else float(total)
    rate = F.col("__w") * F.lit(goal) / F.lit(all_w) / F.col("__n") if all_w else F.lit(0.0)
    parts = F.greatest(F.lit(1), F.ceil(F.col("__rate") / SPLIT).cast("int"))
    rates = sizes.select("__source", rate.alias("__rate")).select("__source", parts.alias("__parts"), thresholds(F.col("__rate") / parts).alias("__at"))
    # written, so that its size is known: Spark broadcasts it if it is small, and else splits a hot source
    rates, _ = shared.written(rates, "rates")
    # null and empty texts draw apart; the digest is taken once, below the join
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("?")), F.coalesce(F.md5(text_col), F.lit("?")))
    out = docs.drop("copy", "shuffle_key").withColumn("__key", key).join(rates, src.eqNullSafe(F.col("__source")))
    draws = F.transform(F.sequence(F.lit(1), F.col("__parts")), lambda k: poisson(F.col("__at"), uniform(F.col("__key"), k.cast("string"))))
    count = F.aggregate(draws, F.lit(0), lambda a, b: a + b)
    out = out.withColumn("copy", F.explode(F.transform(F.array_repeat(F.lit(0), count), lambda _, i: i + 1)))
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit("shuffle"), "__key", F.col("copy").cast("string"))))
    out = out.drop("__source", "__parts", "__at", "__key")
    # dealing by the key's hash and sorting by the key within each task makes a random order overall
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
