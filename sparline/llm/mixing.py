"""A mix of sources by hierarchical budgets over a domain - language - source tree."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparline.functions.text import source_key, token_count
from sparline.session import cut

#: Rows of a leaf that one task orders when it looks for the end of a prefix.
BUCKET_ROWS = 10_000


@dataclass
class Node:
    """A node of the tree; a leaf has a weight and a capacity of its own."""

    weight: float = 0.0
    room: float = 0.0
    budget: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)


def build_tree(leaves: Mapping[tuple[str, ...], tuple[float, float]]) -> Node:
    """The tree of leaf paths with (weight, capacity); every node has the sums of its leaves."""
    root = Node()
    for path, (weight, room) in sorted(leaves.items()):
        at = root
        for name in (None, *path):
            at = at if name is None else at.children.setdefault(name, Node())
            at.weight += weight
            at.room += room
    return root


def spread(node: Node, budget: float) -> None:
    """Give ``budget`` to the node and divide it among its children by weight, none beyond its capacity.

    What a full child can't take goes to its siblings; only what all of them can't take
    stays with the node, whose own siblings got it before, as it was capped there.
    """
    node.budget = min(budget, node.room)
    open_, left = dict(node.children), node.budget
    while open_:
        if left >= sum(c.room for c in open_.values()):  # rooms are whole numbers: a leaf that is used up is so exactly
            for c in open_.values():
                spread(c, c.room)
            return
        total = sum(c.weight for c in open_.values())
        full = [k for k, c in open_.items() if total <= 0 or c.room <= left * c.weight / total]
        if not full:
            for c in open_.values():
                spread(c, left * c.weight / total)
            return
        for k in full:
            c = open_.pop(k)
            spread(c, min(c.room, left))
            left -= c.budget


def leaf_budgets(root: Node, depth: int) -> dict[tuple[str, ...], float]:
    level: dict[tuple[str, ...], Node] = {(): root}
    for _ in range(depth):
        level = {(*path, k): c for path, n in level.items() for k, c in n.children.items()}
    return {path: n.budget for path, n in level.items()}


def language_key(lang) -> F.Column:
    """Two lower-case letters before any region, else ``und``: 677 values at most."""
    code = F.regexp_extract(F.lower(F.coalesce(lang, F.lit(""))), r"^\s*([a-z]{2})(?:[-_].*)?\s*$", 1)
    return F.when(code != "", code).otherwise("und")


@dataclass
class Mix:
    """``rows``: the mix, one row per use of a record. ``report``: a row per target."""

    rows: DataFrame
    report: DataFrame


def mix(
    df: DataFrame,
    targets: DataFrame,
    domains: Mapping[str, str],
    *,
    ident: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    seed: int = 42,
) -> Mix:
    """Combine records so that each source of ``targets`` has its share of the tokens.

    targets: source_name, target_share, max_repeats, at most a few thousand rows; null is 0
    in either number, and of several rows of a source the largest numbers count. The size
    of the mix is that of all records whose source is a target. A leaf of the tree is a
    source in a language; its weight is the target of its source in proportion to its
    tokens, its capacity max_repeats times its tokens. Each leaf is used in whole epochs
    and, for the rest of its budget, a prefix of the next epoch in an order hashed from
    the seed, the epoch and the id. Records without a known source are left out; records
    without a token, null texts too, take part in the epochs they fall into; repeated
    rows count each. A target without records is reported with nothing.
    rows: ident, source_name, lang, epoch (from 0), n_tokens. report: source_name,
    target_share, max_repeats, tokens_available, tokens_used, reached_share and can_reach,
    which is false for a source whose capacity the mix used up without reaching its share.
    """
    spark = df.sparkSession
    shares = targets.select(source_key(F.col("source_name")).alias("s"), F.col("target_share").cast("double").alias("t"), F.col("max_repeats").cast("int").alias("r"))
    shares = shares.where(F.col("s").isNotNull()).groupBy("s").agg(F.max("t").alias("t"), F.max("r").alias("r"))
    wanted = {r["s"]: (r["t"] or 0.0, r["r"] or 0) for r in shares.collect()}
    names = F.broadcast(spark.createDataFrame([(s,) for s in wanted] or [], "source_name string"))
    sized = df.select(
        F.col(ident).alias("__id"), source_key(F.col(source)).alias("source_name"), language_key(F.col(lang)).alias("lang"), token_count(F.col(text)).alias("n_tokens")
    )
    sized = cut(sized.join(names, "source_name"))
    stats = sized.groupBy("source_name", "lang").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("rows")).collect()

    have: dict[str, int] = dict.fromkeys(wanted, 0)
    for r in stats:
        have[r["source_name"]] += r["n"]
    total = sum(have.values())
    leaves, at = {}, {}
    for r in stats:
        s = r["source_name"]
        share, repeats = wanted[s]
        path = (domains.get(s, "other"), r["lang"], s)
        leaves[path] = (share * r["n"] / have[s] if have[s] else 0.0, repeats * r["n"])
        at[path] = r
    root = build_tree(leaves)
    spread(root, float(total))
    plan = []
    for path, budget in leaf_budgets(root, 3).items():
        r = at[path]
        whole = math.floor(budget + 1e-6)
        epochs = whole // r["n"] if r["n"] else 0
        bits = max(0, math.ceil(math.log2(max(1, r["rows"] / BUCKET_ROWS))))
        plan.append((path[2], path[1], int(epochs), int(whole - epochs * r["n"]), bits))
    schema = "source_name string, lang string, __epochs int, __rest bigint, __bits int"
    budgets = F.broadcast(spark.createDataFrame(plan, schema))  # sources x 677 rows at most

    rows = sized.join(budgets, ["source_name", "lang"])
    whole = rows.where("__epochs > 0").select("__id", "source_name", "lang", F.explode(F.sequence(F.lit(0), F.col("__epochs") - 1)).alias("epoch"), "n_tokens")

    leaf = ["source_name", "lang"]
    place = F.xxhash64(F.lit(seed), "__epochs", "__id").bitwiseAND(F.lit((1 << 62) - 1))
    nexts = rows.where("__rest > 0").withColumn("__place", place)
    nexts = nexts.withColumn("__bucket", F.expr("shiftright(__place, 62 - __bits)"))
    sums = nexts.groupBy(*leaf, "__bucket").agg(F.sum("n_tokens").alias("__sum"))
    run = Window.partitionBy(*leaf).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*leaf, "__bucket", F.coalesce(F.sum("__sum").over(run), F.lit(0)).alias("__before"), "__sum")
    nexts = nexts.join(sums, [*leaf, "__bucket"])
    inside = nexts.where("__before + __sum <= __rest")
    order = Window.partitionBy(*leaf, "__bucket").orderBy("__place", "__id").rowsBetween(Window.unboundedPreceding, 0)
    last = nexts.where("__before <= __rest AND __before + __sum > __rest")
    last = last.withColumn("__to", F.col("__before") + F.sum("n_tokens").over(order)).where("__to <= __rest")
    out = ["__id", "source_name", "lang", F.col("__epochs").alias("epoch"), "n_tokens"]
    mixed = whole.unionAll(inside.select(*out)).unionAll(last.select(*out))

    used = mixed.groupBy("source_name").agg(F.sum("n_tokens").alias("tokens_used"))
    there = sized.groupBy("source_name").agg(F.sum("n_tokens").alias("tokens_available"))
    sources = shares.select(F.col("s").alias("source_name"), F.coalesce("t", F.lit(0.0)).alias("target_share"), F.coalesce("r", F.lit(0)).alias("max_repeats"))
    report = sources.join(there, "source_name", "left").join(used, "source_name", "left").na.fill(0, ["tokens_available", "tokens_used"])
    everything = Window.partitionBy()  # a row per target
    size, mixed_size = (F.sum(c).over(everything) for c in ("tokens_available", "tokens_used"))
    # A source is short if the mix used up its last repeat and still has less of it than its share of the size.
    used_up = F.col("tokens_used") >= F.col("max_repeats") * F.col("tokens_available")
    report = report.withColumns({
        "reached_share": F.coalesce(F.try_divide("tokens_used", mixed_size), F.lit(0.0)),
        "can_reach": ~(used_up & (F.col("tokens_used") < F.col("target_share") * size)),
    })
    return Mix(mixed.withColumnRenamed("__id", ident), report)
