"""Structure learning from the command line: ``python -m quillon --random 100 --features 10``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillon.operators import k2
from quillon.sources import matrices


def parse(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quillon", description="Finds the parents of each feature of a matrix.")
    given = p.add_mutually_exclusive_group(required=True)
    given.add_argument("--matrix", help="a text file or folder of numbers parted by blanks, one observation a line")
    given.add_argument("--random", type=int, metavar="M", help="M observations of independent features")
    p.add_argument("--features", type=int, default=10, help="how many features a row has (default 10)")
    p.add_argument("--probability", type=float, default=0.7, help="of a 1 in --random (default 0.7)")
    p.add_argument("--seed", type=int, help="of --random")
    p.add_argument("--parents", type=int, default=2, help="how many parents a feature has at most (default 2)")
    p.add_argument("--out", help="where the map of parents is written; printed if this is left out")
    p.add_argument("--kind", choices=("text", "parquet", "json"), default="text", help="of --out (default text)")
    got = p.parse_args(args)
    if got.features < 1 or got.parents < 0 or (got.random is not None and got.random < 1) or not 0 <= got.probability <= 1:
        p.error("--features and --random are 1 or more, --parents 0 or more, --probability 0 to 1")
    return got


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    got = parse(sys.argv[1:] if args is None else args)
    spark = spark or SparkSession.builder.getOrCreate()
    matrix = matrices.read_matrix(spark, got.matrix) if got.matrix else matrices.bernoulli_matrix(spark, got.random, got.features, got.probability, got.seed)
    began = time.time()
    found = k2.parent_map(k2.k2(matrix, got.features, u=got.parents))
    if got.out:
        matrices.write_parent_map(found, got.out, got.kind)
    else:
        for r in found.orderBy("node").select(F.col("node"), F.col("parents"), F.round("score", 6).alias("score")).collect():
            print(r.node, r.parents, r.score)
    print(f"{time.time() - began:.3f} s", file=sys.stderr)


if __name__ == "__main__":
    main()
