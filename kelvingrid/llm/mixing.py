"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree of domains, languages and sources in proportion to their weights.  A node can
take no more than its capacity (its tokens times the most epochs).  What a child can't take goes to its siblings, by weight, until
they are full; only what a whole family can't take goes to the families beside it, since a family's capacity is
the sum of its members'.  Each leaf then takes whole epochs of its documents and a token-prefix of one more,
in an order drawn anew for each epoch from a seeded hash.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from kelvingrid.session import cut_lineage

LEVELS = ("domain", "lang", "source")
#: Hex digits of the order hash that form the buckets of a leaf; a cut is looked for inside one bucket only.
BUCKET_DIGITS = 3
#: Leaves up to which the plan (one short row a leaf) is broadcast; beyond it the join is left to the optimiser.
BROADCAST_LEAVES = 100_000
WORD = r"[^ \t\n\x0B\f\r]+"


@dataclass(frozen=True)
class Recipe:
    """Weights by name at each level (``default`` for names that are not listed), budget as a share of all tokens, most epochs, seed."""

    domain: Mapping[str, float] = field(default_factory=dict)
    lang: Mapping[str, float] = field(default_factory=dict)
    source: Mapping[str, float] = field(default_factory=dict)
    default: float = 1.0
    share: float = 0.5
    max_epochs: int = 2
    seed: int = 0

    def weight(self, level: str) -> Column:
        out = F.lit(float(self.default))
        for name, w in sorted(getattr(self, level).items()):
            out = F.when(F.col(level) == name, float(w)).otherwise(out)
        return out


def token_counts(docs: DataFrame, domain: Column) -> DataFrame:
    """Slim rows (doc_id, domain, lang, source, n_tokens); tokens are words, null names are the empty name."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(domain, F.lit("")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"),
    )


def _shared(children: DataFrame, parent: list[str], level: str, recipe: Recipe) -> DataFrame:
    """``budget`` of each child from ``parent_budget`` by weight, up to ``capacity``: the level at which the family's water stands, from sorted prefix sums."""
    # children in order of the level at which they are full
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = family.orderBy(F.col("capacity") / F.col("weight"), level)
    earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = children.withColumn("weight", recipe.weight(level)).filter("weight > 0")
    w = w.withColumn("water", (F.col("parent_budget") - F.coalesce(F.sum("capacity").over(earlier), F.lit(0.0))) / F.sum("weight").over(later))
    w = w.withColumn("water", F.min(F.when(F.col("capacity") > F.col("weight") * F.col("water"), F.struct(F.col("capacity") / F.col("weight"), F.col(level), F.col("water").alias("water")))).over(family)["water"])
    return w.withColumn("budget", F.when(F.col("water").isNull(), F.col("capacity")).otherwise(F.least("capacity", F.greatest(F.lit(0.0), F.col("weight") * F.col("water"))))).drop("weight", "water", "parent_budget")


def leaf_budgets(counts: DataFrame, recipe: Recipe) -> DataFrame:
    """(domain, lang, source, tokens, budget, epochs, rest): one row per leaf with tokens; names of weight 0 get nothing and have no row."""
    leaves = counts.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).withColumn("capacity", F.col("tokens").cast("double") * recipe.max_epochs)
    total = F.floor(F.sum("tokens").over(Window.partitionBy(F.lit(0))) * F.lit(float(recipe.share))).cast("double")
    nodes = leaves.withColumn("total", total)
    langs = nodes.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"), F.max("total").alias("total"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.max("total").alias("parent_budget"))
    given = _shared(domains, [], "domain", recipe).select("domain", F.col("budget").alias("parent_budget"))
    given = _shared(langs.drop("total").join(given, "domain"), ["domain"], "lang", recipe).select("domain", "lang", F.col("budget").alias("parent_budget"))
    out = _shared(nodes.drop("total").join(given, ["domain", "lang"]), ["domain", "lang"], "source", recipe)
    whole = F.floor(F.col("budget") + 1e-6).cast("long")
    out = out.select(*LEVELS, "tokens", whole.alias("budget"))
    epochs = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("long")
    return out.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))


def order_hash(seed: int, epochs: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epochs.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _with_plan(rows: DataFrame, plan: DataFrame, leaves: int, names: Mapping[str, Column]) -> DataFrame:
    small = F.broadcast(plan) if leaves <= BROADCAST_LEAVES else plan
    keyed = rows.withColumns({f"__{level}": names[level] for level in LEVELS})
    renamed = small.select(*(F.col(level).alias(f"__{level}") for level in LEVELS), *(F.col(c).alias(f"__{c}") for c in plan.columns if c not in LEVELS))
    return keyed.join(renamed, [f"__{level}" for level in LEVELS], "left")


def mixing_plan(counts: DataFrame, recipe: Recipe) -> tuple[DataFrame, int]:
    """Leaf rows (domain, lang, source, epochs, cut) and their number: documents take part in the next epoch if their order hash is at most ``cut``.

    The cut is found by token sums per (leaf, bucket of the hash), then inside the one bucket that the budget ends
    in; a leaf of a third of all rows is never gathered.
    """
    budgets = cut_lineage(leaf_budgets(counts, recipe))
    leaves = budgets.count()
    names = {level: F.col(level) for level in LEVELS}
    hashed = _with_plan(counts, budgets, leaves, names).filter(F.col("__rest").isNotNull()).withColumn("h", order_hash(recipe.seed, F.col("__epochs"), F.col("doc_id")))
    hashed = hashed.withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    sums = hashed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("held"), F.max("__rest").alias("rest"))
    upto = Window.partitionBy(*LEVELS).orderBy("bucket")
    over = sums.withColumn("upto", F.sum("held").over(upto)).filter("upto > rest")
    ends = over.groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("held")).alias("base"))).alias("e")).select(*LEVELS, F.col("e.bucket").alias("last"), F.col("e.base").alias("base"))
    ends = cut_lineage(ends)
    inside = _with_plan(hashed.select(*LEVELS, "bucket", "h", "n_tokens", F.col("__rest").alias("rest")), ends, leaves, names).filter(F.col("bucket") == F.col("__last"))
    run = Window.partitionBy(*LEVELS).orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = inside.withColumn("upto", F.col("__base") + F.sum("n_tokens").over(run)).filter("upto <= rest").groupBy(*LEVELS).agg(F.max("h").alias("fit"))
    plan = budgets.join(ends, list(LEVELS), "left").join(fits, list(LEVELS), "left")
    # without a last bucket everything fits; "g" is above all hashes
    return cut_lineage(plan.select(*LEVELS, "epochs", F.coalesce("fit", "last", F.lit("g")).alias("cut"))), leaves


def _counted(rows: DataFrame, plan: DataFrame, leaves: int, names: Mapping[str, Column], recipe: Recipe) -> DataFrame:
    """Adds ``__copies``: how many times the mixture takes each row."""
    more = (order_hash(recipe.seed, F.col("__epochs"), F.col("doc_id")) <= F.col("__cut")).cast("int")
    taken = F.when(F.col("__epochs").isNotNull(), F.least(F.col("__epochs") + more, F.lit(recipe.max_epochs)))
    copies = F.coalesce(taken, F.lit(0)).cast("long")
    return _with_plan(rows, plan, leaves, names).withColumn("__copies", copies)


def mixture(docs: DataFrame, domain: Column, recipe: Recipe) -> DataFrame:
    """Rows (doc_id, domain, lang, source, n_tokens, copies), one per document, also for those not taken (0 copies).

    A document without words takes no budget and is taken with the prefix it falls into.  Rows that share an id
    stand at one place of the order and are taken together.  Null lang, source or domain is a name of its own (empty).  Weight 0: never taken.
    An empty table gives no rows.  Extra columns are not read.  No text is shuffled; per leaf one row is
    gathered, per (leaf, bucket) one sum.
    """
    counts = cut_lineage(token_counts(docs, domain))
    plan, leaves = mixing_plan(counts, recipe)
    taken = _counted(counts, plan, leaves, {level: F.col(level) for level in LEVELS}, recipe)
    return taken.select("doc_id", *LEVELS, "n_tokens", F.col("__copies").alias("copies"))


def take_mixture(docs: DataFrame, domain: Column, recipe: Recipe) -> DataFrame:
    """The documents themselves, each as often as the mixture takes it, with their own columns only."""
    counts = cut_lineage(token_counts(docs, domain))
    plan, leaves = mixing_plan(counts, recipe)
    names = {"domain": F.coalesce(domain, F.lit("")), "lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit(""))}
    taken = _counted(docs, plan, leaves, names, recipe).filter("__copies > 0")
    if recipe.max_epochs > 1:
        taken = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return taken.select(*(F.col(f"`{c}`") for c in docs.columns))
