"""Structure learning: parents of each feature by greedy search on the log marginal likelihood.

A matrix is (v array<int>), a row an observation. Identical rows are counted first. One level scores
all candidates of all children in one aggregation: the candidate table, made by a join in blocks of CHUNK rows, is
broadcast to the rows, and only partial counts by parent configuration are shuffled. Configurations
that don't occur add nothing to a score and are never made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.special import log_factorial
from quillon.plans.settle import settle

CHUNK = 1 << 15  # candidates in one broadcast


def _cell(node):
    return F.element_at("v", node + 1)


def compressed(matrix: DataFrame, n: int | None = None, *, pays: float = 0.5) -> DataFrame:
    """(v, w): observations and how often they occur. Null cells are rejected, and with n every row that
    doesn't have n features.

    Equal rows are added up where at most ``pays`` of the rows are estimated to differ; else the rows stay
    where they are, as a shuffle of all of them would save little.
    """
    rows = matrix.select("v")
    found = rows.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.xxhash64("v")).alias("kinds"), F.count_if(F.col("v").isNull() | F.exists("v", lambda x: x.isNull())).alias("bad"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).head()
    if found["bad"]:
        raise ValueError("a matrix has no null cells")
    if n is not None and found["rows"] and (found["least"], found["most"]) != (n, n):
        raise ValueError(f"the matrix has rows of {found['least']} to {found['most']} features, not {n}")
    if found["kinds"] > pays * found["rows"]:
        return settle(rows.withColumn("w", F.lit(1).cast("long")))
    return settle(rows.groupBy("v").agg(F.count(F.lit(1)).alias("w")))


def attribute_domains(matrix: DataFrame) -> DataFrame:
    """(pos, r, vals): the sorted distinct values of each feature."""
    cells = matrix.select(F.posexplode("v").alias("pos", "x")).distinct()
    return cells.groupBy("pos").agg(F.count(F.lit(1)).cast("int").alias("r"), F.sort_array(F.collect_set("x")).alias("vals"))


def alpha(matrix: DataFrame, mask: list[tuple[int, int]]) -> int:
    """How many observations have all the given (feature, value) pairs."""
    kept = matrix
    for feature, value in mask:
        kept = kept.where(_cell(F.lit(feature)) == value)
    return kept.count()


def contingency(weighted: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Counts a by (child, cand, c1..ck, x). candidates: (child, r, p1..pk), the last parent being
    the candidate; scalar keys keep the rows inside generated code."""
    keys = [_cell(F.col(f"p{t}")).alias(f"c{t}") for t in range(1, k + 1)]
    cand = F.col(f"p{k}") if k else F.lit(-1)
    rows = weighted.crossJoin(F.broadcast(candidates)).select("child", "r", cand.alias("cand"), *keys, _cell(F.col("child")).alias("x"), "w")
    return rows.groupBy("child", "r", "cand", *[f"c{t}" for t in range(1, k + 1)], "x").agg(F.sum("w").alias("a"))


def scores(weighted: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(child, cand, score): the log of the K2 score of each candidate."""
    cfg = [f"c{t}" for t in range(1, k + 1)]
    by_cfg = contingency(weighted, candidates, k).groupBy("child", "r", "cand", *cfg).agg(F.sum("a").alias("n"), F.sum(log_factorial(F.col("a"))).alias("inner"))
    term = log_factorial(F.col("r") - 1) - log_factorial(F.col("n") + F.col("r") - 1) + F.col("inner")
    return by_cfg.groupBy("child", "cand").agg(F.sum(term).alias("score"))


def score_over_product(matrix: DataFrame, child: int, parents: list[int]) -> DataFrame:
    """(score): of one child, from a row for every combination of its parents' values, also those that
    don't occur; they add ln 1. The same number as ``scores`` gives, which never makes those rows."""
    values = lambda f: matrix.select(_cell(F.lit(f)).alias(f"c{f}")).distinct()
    every = matrix.sparkSession.range(1).select()
    for p in parents:
        every = every.crossJoin(F.broadcast(values(p)))  # domains are small
    r = values(child).count()
    names = [f"c{p}" for p in parents]
    counts = matrix.groupBy(*[_cell(F.lit(p)).alias(f"c{p}") for p in parents], _cell(F.lit(child)).alias("x")).agg(F.count(F.lit(1)).alias("a"))
    by = counts.groupBy(*names).agg(F.sum("a").alias("n"), F.sum(log_factorial(F.col("a"))).alias("inner"))
    met = every.join(by, names, "left") if names else by
    term = log_factorial(F.lit(r - 1)) - log_factorial(F.coalesce("n", F.lit(0)) + r - 1) + F.coalesce("inner", F.lit(0.0))
    return met.agg(F.sum(term).alias("score"))


def _best(weighted: DataFrame, state: list[tuple], features: DataFrame, k: int) -> dict[int, tuple[float, int]]:
    """Of each child its best candidate, ties to the smaller feature. state: (child, r, place, p1..) of the
    children that are still searched, in their order; features: (z, place). Candidates are made by a join
    for blocks of children with CHUNK candidates at most, or of one child; a row for each child comes back."""
    best: dict[int, tuple[float, int]] = {}
    spark, before = weighted.sparkSession, [f"p{t}" for t in range(1, k)]
    schema = "child int, r int, place int" + "".join(f", {p} int" for p in before)
    at = 0
    while at < len(state):
        end, held = at + 1, state[at][2]
        while end < len(state) and held + state[end][2] <= CHUNK:
            held, end = held + state[end][2], end + 1
        block, at = spark.createDataFrame(state[at:end], schema), end
        if k:
            earlier = features.select(F.col("z").alias(f"p{k}"), F.col("place").alias("of"))
            new = F.col("of") < F.col("place")
            for p in before:
                new = new & (F.col(f"p{k}") != F.col(p))
            block = F.broadcast(block).join(earlier, new)
        found = scores(weighted, block.drop("place", "of"), k)
        top = found.groupBy("child").agg(F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("cand")).alias("c"), "score")).alias("b"))
        best |= {child: (b["score"], -b["c"]) for child, b in top.collect()}
    return best


def k2(matrix: DataFrame, n: int, *, order: list[int] | None = None, u: int = 2, children: list[int] | None = None) -> DataFrame:
    """(child, step, parent, score): step 0 with parent -1 and the score without parents, then a row
    for each accepted parent, in the order of discovery.

    order: a permutation of the n features; only earlier ones may be parents. A parent is accepted if
    it raises the score by more than rounding (1e-9, or that share of it). children: search only these.
    ValueError where order, children, u or a row of the matrix doesn't fit n.
    """
    order = list(range(n)) if order is None else order
    if sorted(order) != list(range(n)):
        raise ValueError(f"order must be a permutation of {n} features")
    if u < 0 or children is not None and not set(children) <= set(order):
        raise ValueError(f"u is 0 or more, and children are some of {n} features")
    spark, weighted = matrix.sparkSession, compressed(matrix, n)
    sizes = {p: r for p, r in attribute_domains(weighted).select("pos", "r").collect()}
    wanted = [c for c in order if children is None or c in children]
    if not sizes:
        return spark.createDataFrame([], "child int, step int, parent int, score double")
    place = {c: i for i, c in enumerate(order)}
    features = spark.createDataFrame([(z, i) for z, i in place.items()], "z int, place int")
    parents: dict[int, list[int]] = {c: [] for c in wanted}
    state = lambda of: [(c, sizes[c], place[c], *parents[c]) for c in of]
    old = {c: s for c, (s, _) in _best(weighted, state(wanted), features, 0).items()}
    out, active = [(c, 0, -1, old[c]) for c in wanted], list(wanted)
    for k in range(1, u + 1):
        active = [c for c in active if place[c] >= k]
        found = _best(weighted, state(active), features, k) if active else {}
        active = [c for c in active if c in found and found[c][0] > old[c] + 1e-9 * max(1.0, abs(old[c]))]
        for c in active:
            old[c], z = found[c]
            parents[c].append(z)
            out.append((c, k, z, old[c]))
        if not active:
            break
    return spark.createDataFrame(out, "child int, step int, parent int, score double")


def parent_map(edges: DataFrame) -> DataFrame:
    """(node, parents in the order of discovery, score) from what k2 returns."""
    found = edges.groupBy("child").agg(F.sort_array(F.collect_list(F.struct("step", "parent", "score"))).alias("e"))
    return found.select(F.col("child").alias("node"), F.transform(F.filter("e", lambda x: x["step"] > 0), lambda x: x["parent"]).alias("parents"), F.element_at("e", -1)["score"].alias("score"))


def parents_by_column(edges: DataFrame) -> DataFrame:
    """(node, p1, p2) of what k2 returns with u of 2 at most, null where there is none."""
    parent = lambda k: F.max(F.when(F.col("step") == k, F.col("parent"))).alias(f"p{k}")
    return edges.groupBy(F.col("child").alias("node")).agg(parent(1), parent(2))


def snake_schedule(spark, jobs: int, size: int) -> DataFrame:
    """(job, rank): jobs dealt to ranks in a snake, forth and back."""
    block = F.floor(F.col("id") / size)
    return spark.range(jobs).select(F.col("id").alias("job"), F.when(block % 2 == 0, F.col("id") % size).otherwise(size - 1 - F.col("id") % size).alias("rank"))
