"""Attribution kernels on arrays: gradients of a linear scorer, path integrals, attention pooling."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def gradient_x_input(embedding: Column, gradient: Column) -> Column:
    return dot(embedding, gradient)


def gradient_sum(gradient: Column) -> Column:
    return F.aggregate(gradient.cast("array<double>"), F.lit(0.0), lambda s, x: s + x)


def gauss_legendre(n: int) -> list[tuple[float, float]]:
    """Nodes and weights on [0, 1]."""
    x, w = np.polynomial.legendre.leggauss(n)
    return [(float((a + 1) / 2), float(b / 2)) for a, b in zip(x, w)]


def integrated_gradient(df: DataFrame, ident: str, embedding: str, weights: list[float], steps: int) -> DataFrame:
    """Path integral from the zero vector for the scorer f(e) = sigmoid(w . e): ident, attribution, f_input, f_baseline, error.

    The gradient at a point of the path is w f (1 - f), so a token's attribution is w . e
    times the integral of f (1 - f) along the path: one row per token, the nodes as literals.
    """
    z = dot(F.col(embedding), F.array(*map(F.lit, weights)))
    rows = df.select(ident, z.alias("__z"))
    f = lambda v: 1 / (1 + F.exp(-v))
    part = F.lit(0.0)
    for node, weight in gauss_legendre(steps):
        s = f(F.col("__z") * node)
        part = part + weight * s * (1 - s)
    out = rows.select(ident, (F.col("__z") * part).alias("attribution"), f(F.col("__z")).alias("f_input"), F.lit(1 / (1 + math.exp(0.0))).alias("f_baseline"))
    return out.withColumn("error", F.abs(F.col("attribution") - (F.col("f_input") - F.col("f_baseline"))))


def pool_attention(maps: DataFrame, unit: list[str], last_layers: int | None, heads: str = "mean") -> DataFrame:
    """Attention of the query position by key: mean or max over heads, then mean over the last layers (all if None).

    maps: unit, layer, head, key, weight.
    """
    from pyspark.sql import Window

    rows = maps
    if last_layers is not None:
        rows = rows.withColumn("__last", F.max("layer").over(Window.partitionBy(*unit))).where(F.col("layer") > F.col("__last") - last_layers)
    pooled = rows.groupBy(*unit, "layer", "key").agg((F.avg if heads == "mean" else F.max)("weight").alias("__w"))
    return pooled.groupBy(*unit, "key").agg(F.avg("__w").alias("score"))


def interpolated(baseline: Column, embedding: Column, alpha: Column) -> Column:
    """The point of the straight path from the baseline to the embedding."""
    return F.zip_with(baseline.cast("array<double>"), embedding.cast("array<double>"), lambda b, e: b + alpha * (e - b))


def baseline(embedding: Column, strategy: str, pad: Column | None = None, explicit: Column | None = None) -> Column:
    """Where a path begins: ZERO_EMBEDDING, PAD_EMBEDDING (one vector for all) or EXPLICIT (a column of the same width)."""
    if strategy == "ZERO_EMBEDDING":
        return F.transform(embedding, lambda _: F.lit(0.0))
    given = {"PAD_EMBEDDING": pad, "EXPLICIT": explicit}.get(strategy)
    if given is None:
        raise ValueError(f"no baseline for {strategy}")
    wrong = F.raise_error(F.lit("the baseline has another width")).cast("array<double>")
    return F.when(F.size(given) == F.size(embedding), given.cast("array<double>")).otherwise(wrong)


def _path_nodes(steps: int, rule: str) -> list[tuple[float, float]]:
    if rule == "GAUSS_LEGENDRE":
        return gauss_legendre(steps)
    if rule == "RIEMANN":
        return [((i + 0.5) / steps, 1.0 / steps) for i in range(steps)]
    raise ValueError(rule)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def path_gradient(df: DataFrame, ident: str, embedding: str, start: Column, weights: list[float], steps: int, rule: str = "GAUSS_LEGENDRE") -> DataFrame:
    """Integrated gradients of f(e) = sigmoid(w . e) from any baseline: ident, per dimension ``attributions``, their sum ``attribution``, f_input, f_baseline, e_abs, e_rel.

    The gradient at every node of the path is w f (1 - f); the weighted sum over the nodes
    times the difference to the baseline is the attribution.
    """
    w = F.array(*map(F.lit, weights))
    e, b = F.col(embedding).cast("array<double>"), start
    f = lambda v: 1 / (1 + F.exp(-v))
    nodes = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(k).alias("k")) for a, k in _path_nodes(steps, rule)))

    def slope(z: Column) -> Column:
        at = lambda n: f(z[0] + n["a"] * (z[1] - z[0]))
        return F.aggregate(nodes, F.lit(0.0), lambda s, n: s + n["k"] * at(n) * (1 - at(n)))

    def parts(z: Column) -> Column:
        ends = F.zip_with(F.zip_with(e, b, lambda x, y: x - y), w, lambda d, x: d * x)
        return F.struct(f(z[1]).alias("f1"), f(z[0]).alias("f0"), _let(slope(z), lambda k: F.transform(ends, lambda x: x * k)).alias("parts"))

    found = _let(F.array(dot(b, w), dot(e, w)), parts).alias("__r")
    out = df.select(ident, found).select(
        ident, F.col("__r.parts").alias("attributions"), F.aggregate("__r.parts", F.lit(0.0), lambda s, x: s + x).alias("attribution"),
        F.col("__r.f1").alias("f_input"), F.col("__r.f0").alias("f_baseline"),
    )
    return with_errors(out)


def with_errors(df: DataFrame, floor: float = 1e-3) -> DataFrame:
    """Adds e_abs, how far attributions are from the difference of the scores, and e_rel, that over the difference (``floor`` at least)."""
    delta = F.col("f_input") - F.col("f_baseline")
    error = F.abs(F.col("attribution") - delta)
    return df.withColumns({"e_abs": error, "e_rel": error / F.greatest(F.abs(delta), F.lit(floor))})


def path_gradient_with_retry(
    df: DataFrame, ident: str, embedding: str, start: Column, weights: list[float], steps: int = 50, retry_steps: int = 100, tolerance: float = 0.05, rule: str = "GAUSS_LEGENDRE"
) -> DataFrame:
    """``path_gradient`` with few steps, again with more for those that miss the relative ``tolerance``: adds steps and state OK or NONCONVERGED."""
    fails = F.col("e_rel") > tolerance
    first = path_gradient(df, ident, embedding, start, weights, steps, rule)
    again = path_gradient(df.join(first.where(fails).select(ident), ident, "left_semi"), ident, embedding, start, weights, retry_steps, rule)
    done = first.where(~fails).withColumn("steps", F.lit(steps)).unionByName(again.withColumn("steps", F.lit(retry_steps)))
    return done.withColumn("state", F.when(fails, "NONCONVERGED").otherwise("OK"))


def accumulated(gradients: DataFrame, unit: list[str], dims: str = "gradient") -> DataFrame:
    """The weighted sum of gradients over the nodes of a path: unit, one value per dimension. gradients: unit, weight, ``dims`` (array)."""
    flat = gradients.select(*unit, "weight", F.posexplode(dims).alias("__i", "__g"))
    sums = flat.groupBy(*unit, "__i").agg(F.sum(F.col("weight") * F.col("__g")).alias("__s"))
    return sums.groupBy(*unit).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__s"))), lambda x: x["__s"]).alias(dims))


def query_index(policy: str, length: Column, classification: Column | None = None, explicit: int | None = None) -> Column:
    """The position whose attention is read, by policy; outside the sequence it is an error."""
    at = {"FIRST_ASSISTANT_CLASSIFICATION_TOKEN": classification, "EXPLICIT_INDEX": None if explicit is None else F.lit(explicit)}.get(policy)
    if at is None:
        raise ValueError(f"no position for {policy}")
    return F.when((at >= 0) & (at < length), at).otherwise(F.raise_error(F.lit("query position outside the sequence")).cast("int"))


def attention_row(queries: Column, keys: Column) -> Column:
    """softmax(q k / sqrt(d)) over the keys, averaged over heads. queries: array by head of vectors; keys: array by head of arrays of vectors."""

    def one(pair: Column) -> Column:
        z = F.transform(pair["k"], lambda k: dot(pair["q"], k) / F.sqrt(F.size(pair["q"]).cast("double")))
        e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
        total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
        return F.transform(e, lambda x: x / total)

    heads = F.transform(F.zip_with(queries, keys, lambda q, k: F.struct(q.alias("q"), k.alias("k"))), one)
    summed = F.aggregate(heads, F.transform(heads[0], lambda _: F.lit(0.0)), lambda s, h: F.zip_with(s, h, lambda a, b: a + b))
    return F.transform(summed, lambda x: x / F.size(heads))


#: The methods (signed, needing gradients, forward passes, for lines, for hunks; passes 0: by steps or regions).
METHODS = (
    ("attention_last", False, False, 1, True, True), ("attention_last4", False, False, 1, True, True), ("gradient", True, True, 1, True, True),
    ("grad_x_input", True, True, 1, True, True), ("integrated_gradients", True, True, 0, True, True), ("occlusion_line", True, False, 0, True, False),
    ("occlusion_hunk", True, False, 0, False, True),
)
#: Presets of attention, with the last layers and how heads are combined.
ATTENTION_PRESETS = (("attention_last_mean", 1, "mean"), ("attention_last_max", 1, "max"), ("attention_last4_mean", 4, "mean"))


def method_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(METHODS), "method string, signed boolean, needs_gradient boolean, passes int, for_lines boolean, for_hunks boolean")


def attention_presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ATTENTION_PRESETS), "preset string, last_layers int, heads string")
