"""Mixing sources to target weights by hierarchical budgeting.

The corpus is a tree: domain, language, source. A token budget goes from the root down:
each node's amount is divided among its children in proportion to their weights, but no
child gets more than its subtree can give (its tokens times ``max_epochs``). What a child
cannot take goes to its siblings first, by weight; since a node's amount never exceeds
what its subtree can give, only the shortage of a whole subtree reaches the level above,
where it goes to the siblings of that ancestor. The division is water filling: children
in the order of capacity by weight are filled until one is not.

A leaf takes whole epochs of its documents and then a token-prefix of one more epoch in
that epoch's seeded order, up to and including the document that reaches the amount. The
order is a hash of seed, epoch and doc_id. Prefixes are found from token sums of hash
buckets; only the bucket in which a leaf's prefix ends is ordered, so a hot source is
never gathered in one task. A document's choice is then a comparison with its leaf's cut.

Special rows: a null text has no tokens; a null language or source is a node of its own
(empty name); rows with a null doc_id share one place in the order, as do repeated rows:
all of them are in, or none. Extra columns are ignored by ``mixture`` and kept by
``select_documents``. An empty table gives an empty mixture. Nodes of weight 0 get nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.plans.spool import spool

WORDS = r"[^\x20\x09-\x0D]+"
#: The order hash has 60 bits; the first of them, half as many as the number of documents has, are the
#: bucket. So a leaf has about as many buckets as documents in one bucket.
HASH_BITS = 60
DEC = "decimal(19,0)"


@dataclass(frozen=True)
class Mixture:
    """What to aim at. ``levels``: name and expression of each level, root first; ``weights``:
    for each level a SQL expression over the level names that gives whole numbers."""

    levels: tuple[tuple[str, str], ...] = (
        ("domain", "concat('d', coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS bigint), 0) % 3)"),
        ("language", "coalesce(lang, '')"),
        ("origin", "coalesce(source, '')"),
    )
    weights: dict[str, str] = field(default_factory=lambda: {"domain": "CASE domain WHEN 'd0' THEN 3 WHEN 'd1' THEN 2 ELSE 1 END", "language": "CASE language WHEN 'en' THEN 5 ELSE 2 END", "origin": "1"})
    budget: tuple[int, int] = (4, 5)
    max_epochs: int = 2
    seed: int = 17

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.levels]


def with_leaf(docs: DataFrame, aim: Mixture) -> DataFrame:
    """``docs`` with the level columns prefixed by two underscores."""
    return docs.withColumns({f"__{n}": F.expr(e) for n, e in aim.levels})


def order_hash(seed: int, epoch: Column, doc_id: Column) -> Column:
    """60 bits of a hash of seed, epoch and doc_id."""
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def divide(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``nodes`` (parent..., name, amount of the parent, capacity, weight) with ``share``: the child's amount."""
    live = nodes.withColumn("__cap", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0)).cast(DEC)).withColumn("__w", F.greatest("weight", F.lit(0)).cast(DEC))
    ratio = F.when(F.col("__w") > 0, F.col("__cap").cast("double") / F.col("__w").cast("double")).otherwise(F.lit(-1.0))
    of = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = of.orderBy("__ratio", name)
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast(DEC)
    filled = (
        live.withColumn("__ratio", ratio)
        .withColumn("__left", (F.col("amount") - F.coalesce(F.sum("__cap").over(ahead), none)).cast(DEC))
        .withColumn("__others", (F.sum("__w").over(of) - F.coalesce(F.sum("__w").over(ahead), none)).cast(DEC))
        .withColumn("__full", F.col("__cap") * F.col("__others") <= F.col("__left") * F.col("__w"))
        .withColumn("__full", F.min(F.col("__full")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    # The first child that is not filled: what is left there is divided by weight.
    first = F.struct(F.col("__ratio"), F.col(name), F.col("__left"), F.col("__others"))
    rest = F.min(F.when(~F.col("__full"), first)).over(of)
    share = F.when(F.col("__full"), F.col("__cap").cast("bigint")).otherwise(F.expr("__rest.__left * __w div __rest.__others"))
    return filled.withColumn("__rest", rest).withColumn("share", share).drop("__cap", "__w", "__ratio", "__left", "__others", "__full", "__rest")


def leaf_plan(tokens: DataFrame, aim: Mixture) -> DataFrame:
    """The levels' names, tokens, share, epochs (whole ones) and rest of each leaf.

    ``tokens``: one row per leaf. The tree has as many rows as there are sources and
    languages, not documents.
    """
    names = aim.names
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    nodes = tokens.withColumn("capacity", F.col("tokens") * aim.max_epochs)
    budget = F.least(F.expr(f"__total * {aim.budget[0]} div {aim.budget[1]}"), F.col("__total") * aim.max_epochs)
    level = nodes.withColumn("__total", total).withColumn("amount", budget.cast("bigint")).drop("__total")
    for k, name in enumerate(names):
        parent, path = names[:k], names[: k + 1]
        sums = level.groupBy(*path).agg(F.first("amount").alias("amount"), F.sum("capacity").alias("capacity")).withColumn("weight", F.expr(aim.weights[name]).cast("bigint"))
        shares = divide(sums, parent, name).select(*(F.col(n).alias(f"__{n}") for n in path), F.col("share"))
        same = [F.col(n) == F.col(f"__{n}") for n in path]
        level = level.join(shares, same).drop("amount", *(f"__{n}" for n in path)).withColumnRenamed("share", "amount")
    epochs = F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(F.lit(0))
    return level.select(*names, "tokens", F.col("amount").alias("share")).withColumn("epochs", epochs).withColumn("rest", F.col("share") - F.col("epochs") * F.col("tokens"))


def counted(docs: DataFrame, aim: Mixture) -> DataFrame:
    """doc_id, levels, n_tokens of each document, stored: the texts are read once."""
    n = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("bigint")
    rows = with_leaf(docs, aim).select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(f"__{n}").alias(n) for n in aim.names), n.alias("n_tokens"))
    return spool(rows, "mix-counted")


def cuts(rows: DataFrame, aim: Mixture) -> DataFrame:
    """The leaf plan with cut_hash and cut_id: the last document of the leaf's prefix (null: no prefix)."""
    names = aim.names
    plan = spool(leaf_plan(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), aim), "mix-plan")
    partial = plan.where("rest > 0").select(*names, "epochs", "rest")
    bits = max(4, rows.count().bit_length() // 2)
    place = order_hash(aim.seed, F.col("epochs") + 1, F.col("doc_id"))
    placed = rows.join(partial, names).withColumn("hash", place).withColumn("bucket", F.shiftright("hash", HASH_BITS - bits))
    sums = placed.groupBy(*names, "bucket").agg(F.sum("n_tokens").alias("sum"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*names).orderBy("bucket")
    ends = sums.withColumn("before", F.sum("sum").over(upto) - F.col("sum")).where("before < rest and before + sum >= rest").select(*names, "bucket", "before")
    within = Window.partitionBy(*names).orderBy("hash", F.coalesce("doc_id", F.lit(-(1 << 63)))).rowsBetween(Window.unboundedPreceding, -1)
    prefix = placed.join(ends, [*names, "bucket"]).withColumn("ahead", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).where("ahead < rest")
    last = prefix.groupBy(*names).agg(F.max(F.struct("hash", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))).alias("cut"))
    return spool(plan.join(last, names, "left").select(*names, "tokens", "share", "epochs", F.col("cut.hash").alias("cut_hash"), F.col("cut.id").alias("cut_id")), "mix-cuts")


def chosen(rows: DataFrame, plan: DataFrame, aim: Mixture) -> DataFrame:
    """``rows`` (doc_id and ``__`` level columns) with ``__epoch``, once for each epoch that takes them."""
    leaf = plan.select(*(F.col(n).alias(f"__leaf_{n}") for n in aim.names), F.col("epochs").alias("__epochs"), F.col("cut_hash").alias("__cut_hash"), F.col("cut_id").alias("__cut_id"))
    same = [F.col(f"__{n}") == F.col(f"__leaf_{n}") for n in aim.names]
    # The leaf plan has a row per source and language; Spark broadcasts it if its stored size allows.
    held = rows.join(leaf, same)
    hash_, id_ = order_hash(aim.seed, F.col("__epochs") + 1, F.col("doc_id")), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    more = F.coalesce((hash_ < F.col("__cut_hash")) | ((hash_ == F.col("__cut_hash")) & (id_ <= F.col("__cut_id"))), F.lit(False))
    times = (F.col("__epochs") + more.cast("bigint")).cast("int")
    taken = held.withColumn("__times", times).where("__times > 0")
    return taken.withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__times", "__epochs", "__cut_hash", "__cut_id", *(f"__leaf_{n}" for n in aim.names))


def mixture(docs: DataFrame, aim: Mixture | None = None) -> DataFrame:
    """doc_id, levels, n_tokens, epoch, order_hash: a row for each document and epoch in the mixture."""
    aim = aim or Mixture()
    rows = counted(docs, aim)
    plan = cuts(rows, aim)
    named = rows.withColumnsRenamed({n: f"__{n}" for n in aim.names})
    taken = chosen(named, plan, aim)
    return taken.select("doc_id", *(F.col(f"__{n}").alias(n) for n in aim.names), "n_tokens", F.col("__epoch").alias("epoch"), order_hash(aim.seed, F.col("__epoch"), F.col("doc_id")).alias("order_hash"))


def select_documents(docs: DataFrame, aim: Mixture | None = None) -> DataFrame:
    """The documents of the mixture with all their columns; one row per epoch that takes them."""
    aim = aim or Mixture()
    plan = cuts(counted(docs, aim), aim)
    return chosen(with_leaf(docs, aim), plan, aim).select(*docs.columns)
