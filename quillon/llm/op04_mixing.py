"""Mixing sources to target weights by hierarchical budgeting over a domain-language-source tree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.plans.settle import settle

#: Production weights; a name that is not listed weighs 1. Whole numbers keep sums exact.
WEIGHTS = {"domain": {"web": 5, "books": 3, "reference": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {}}
BOOKS, REFERENCE = ("src10", "src11", "src12", "src13", "src14"), ("src15", "src16", "src17", "src18", "src19")
SEED, BUCKETS = "mix-1", 3  # hexadecimal digits: 4096 buckets a leaf


def levels() -> dict[str, Column]:
    """The production tree: domain (from the source), language, source; null counts as ''."""
    source = F.coalesce(F.col("source"), F.lit(""))
    domain = F.when(source.isin(*BOOKS), "books").when(source.isin(*REFERENCE), "reference").otherwise("web")
    return {"domain": domain, "lang": F.coalesce(F.col("lang"), F.lit("")), "source": source}


def _weight(level: str, weights: dict) -> Column:
    return reduce(lambda c, kv: c.when(F.col(level) == kv[0], float(kv[1])), weights.get(level, {}).items(), F.when(F.lit(False), 0.0)).otherwise(1.0)


def budgets(supplies: DataFrame, names: list[str], weights: dict, total: Column, max_epochs: int) -> DataFrame:
    """A budget for each leaf of ``supplies`` (names..., supply), as a double. Leaves below a node of
    weight 0 get none, and count as no capacity of the nodes above them.

    From the root down, each node shares its budget among its children by weight, none getting more
    than its leaves can give in ``max_epochs``; what a child can't take goes to its siblings, by
    weight, and only what all siblings together can't take had been left with the ancestors' other
    children. Closed form: in the order of capacity / weight, a child is filled whole if the level
    (budget less the capacities before it, over the weights from it on) reaches its ratio; the others
    get the level of the first that is not, which is the highest of theirs.
    """
    weighs = reduce(lambda a, b: a & b, [_weight(n, weights) > 0 for n in names])
    nodes = supplies.where(weighs).withColumn("cap", F.col("supply") * max_epochs)
    root = nodes.agg(F.sum("cap").alias("all")).select(F.least(total, F.col("all")).cast("double").alias("budget"))
    parent = root
    for k, name in enumerate(names):
        above, path = names[:k], names[: k + 1]
        children = nodes.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(name, weights))
        children = children.join(parent, above) if above else children.crossJoin(F.broadcast(parent))  # one row
        order = Window.partitionBy(*above).orderBy(F.col("cap") / F.col("w"), name) if above else Window.partitionBy().orderBy(F.col("cap") / F.col("w"), name)
        before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rest = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        children = children.withColumn("level", (F.col("budget") - before) / rest).withColumn("full", F.col("cap") / F.col("w") <= F.col("level"))
        level = F.max(F.when(~F.col("full"), F.col("level"))).over(Window.partitionBy(*above))
        parent = children.select(*path, F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level * F.col("w")).alias("budget"))
    return parent


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long")


def _key(epoch: Column, id_col: str) -> Column:
    """A document's place in a leaf's epoch; the id's hash, so that it needs no state."""
    return F.md5(F.concat_ws(":", F.lit(SEED), epoch.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def mixture(docs: DataFrame, *, tree: dict[str, Column], weights: dict, share: float = 0.5, max_epochs: int = 2, id_col: str = "doc_id", text_col: str = "text", tokens=word_count) -> DataFrame:
    """The plan, a row for each leaf: the tree's names, supply, budget, whole_epochs, cut.

    The budget of the root is ``share`` of all tokens. A leaf's documents are taken whole_epochs times,
    and in the seeded order of the next epoch once more up to the key ``cut``, the longest prefix whose
    tokens fit what is left (null: none). The order is never sorted as one: sums by hash bucket find
    the one bucket of a leaf where its budget ends, and only that is sorted.
    """
    names = list(tree)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), *[c.alias(n) for n, c in tree.items()], tokens(text).alias("t"), F.xxhash64(text).alias("x"))
    rows = settle(rows.hint("rebalance", "__id"))  # few bytes a row: not a small file for each part of docs
    supplies = rows.groupBy(*names).agg(F.sum("t").alias("supply"))
    total = supplies.agg(F.sum("supply").alias("s")).head()["s"] or 0
    leaves = budgets(supplies, names, weights, F.lit(int(total * share)), max_epochs).join(supplies, names)
    leaves = leaves.withColumn("budget", F.floor("budget")).withColumn("whole_epochs", F.coalesce(F.try_divide(F.col("budget"), F.col("supply")).cast("long"), F.lit(0)))
    leaves = settle(leaves.withColumn("left", F.col("budget") - F.col("whole_epochs") * F.col("supply")))

    keyed = rows.join(leaves.where("left > 0").select(*names, "whole_epochs", "left"), names)
    keyed = keyed.select(*names, "left", "t", F.concat_ws("-", _key(F.col("whole_epochs"), "__id"), F.hex("x")).alias("key")).withColumn("bucket", F.substring("key", 1, BUCKETS))
    sums = keyed.groupBy(*names, "left", "bucket").agg(F.sum("t").alias("t"), F.max("key").alias("last"))
    sums = settle(sums.withColumn("upto", F.sum("t").over(Window.partitionBy(*names).orderBy("bucket"))))
    whole = sums.where(F.col("upto") <= F.col("left")).groupBy(*names).agg(F.max("last").alias("cut"))
    edge = sums.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("t") <= F.col("left"))).select(*names, "bucket", (F.col("left") - F.col("upto") + F.col("t")).alias("room"))
    within = keyed.join(edge, [*names, "bucket"]).withColumn("upto", F.sum("t").over(Window.partitionBy(*names, "bucket").orderBy("key")))
    part = within.where(F.col("upto") <= F.col("room")).groupBy(*names).agg(F.max("key").alias("cut"))
    cuts = whole.unionByName(part).groupBy(*names).agg(F.max("cut").alias("cut"))
    return settle(leaves.join(cuts, names, "left").select(*names, "supply", "budget", "whole_epochs", "cut"))


def mix(docs: DataFrame, *, tree: dict[str, Column] | None = None, weights: dict | None = None, id_col: str = "doc_id", text_col: str = "text", tokens=word_count, **planning) -> DataFrame:
    """The rows of docs that are taken, all their columns, and ``copies``: how many times.

    Ids and texts that repeat together have the same place in the order and are taken together; a
    null id counts as ''. Nulls in the tree's columns are leaves of their own. Documents without
    tokens come with whatever they are next to. An empty table gives no rows. Texts are not shuffled
    unless the plan, a row for each leaf, is too large to broadcast. A column named copies is replaced.
    """
    tree, weights = tree or levels(), weights or WEIGHTS
    names = list(tree)
    plan = mixture(docs, tree=tree, weights=weights, id_col=id_col, text_col=text_col, tokens=tokens, **planning)
    plan = plan.select(*[F.col(n).alias(f"__{n}") for n in names], F.col("whole_epochs").alias("__e"), F.col("cut").alias("__cut"))
    key = F.concat_ws("-", _key(F.col("__e"), id_col), F.hex(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))))
    out = docs.drop("copies").withColumns({f"__{n}": c for n, c in tree.items()}).join(plan, [f"__{n}" for n in names])
    copies = F.col("__e") + F.coalesce((key <= F.col("__cut")).cast("long"), F.lit(0))
    return out.withColumn("copies", copies).where("copies > 0").drop(*[f"__{n}" for n in names], "__e", "__cut")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs)
    return out.select("doc_id", *[c.alias(n) for n, c in levels().items()], word_count(F.coalesce(F.col("text"), F.lit(""))).alias("n_tokens"), "copies")


def _sql() -> str:
    weight = lambda n: "CASE " + "".join(f"WHEN {n} = '{k}' THEN {float(v)} " for k, v in WEIGHTS[n].items()) + "ELSE 1.0 END" if WEIGHTS[n] else "1.0"
    quoted = lambda x: ", ".join(f"'{s}'" for s in x)
    steps = []
    for k, name in enumerate(WEIGHTS):
        above, path = list(WEIGHTS)[:k], list(WEIGHTS)[: k + 1]
        by = f"PARTITION BY {', '.join(above)}" if above else ""
        p, a = ", ".join(path), f"USING ({', '.join(above)})" if above else "ON true"
        steps.append(f"""
c{k} AS (SELECT * FROM (SELECT {p}, CAST(sum(cap) AS DOUBLE) AS cap, CAST({weight(name)} AS DOUBLE) AS w FROM leaf GROUP BY ALL) JOIN b{k} {a}),
l{k} AS (SELECT *, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c{k} WINDOW o AS ({by} ORDER BY cap / w, {name})),
b{k + 1} AS (SELECT {p}, CASE WHEN cap / w <= level THEN cap ELSE max(CASE WHEN cap / w > level THEN level END) OVER ({by}) * w END AS budget FROM l{k})""")
    return f"""
WITH d AS (
  SELECT doc_id, CASE WHEN coalesce(source, '') IN ({quoted(BOOKS)}) THEN 'books' WHEN coalesce(source, '') IN ({quoted(REFERENCE)}) THEN 'reference' ELSE 'web' END AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents
), every AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply, CAST(sum(n_tokens) AS BIGINT) * 2 AS cap FROM d GROUP BY ALL),
leaf AS (SELECT * FROM every WHERE {' AND '.join(f"{weight(n)} > 0" for n in WEIGHTS)}),
b0 AS (SELECT CAST(least((SELECT CAST(floor(sum(supply) * 0.5) AS BIGINT) FROM every), sum(cap)) AS DOUBLE) AS budget FROM leaf),{','.join(steps)},
p AS (SELECT domain, lang, source, CAST(floor(budget) AS BIGINT) AS budget, supply FROM b3 JOIN leaf USING (domain, lang, source)),
q AS (SELECT *, coalesce(budget // nullif(supply, 0), 0) AS e FROM p),
o AS (SELECT d.*, e, budget - e * supply AS room, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || e || ':' || doc_id)) AS upto FROM d JOIN q USING (domain, lang, source)),
r AS (SELECT *, CAST(e + CASE WHEN room > 0 AND upto <= room THEN 1 ELSE 0 END AS BIGINT) AS copies FROM o)
SELECT doc_id, domain, lang, source, n_tokens, copies FROM r WHERE copies > 0
"""


OP4_SQL = _sql()
