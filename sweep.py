"""Times structure learning over numbers of features and observations: a line of CSV for each, ready for a chart.

``python sweep.py`` (SWEEP_FEATURES=10,20 SWEEP_ROWS=100,10000 SWEEP_PARENTS=2 BENCH_CPUS=8). Every
configuration runs twice; the second run counts, so that start-up and compilation don't. The phases are
those of k2: reading and counting equal rows, then the search.
"""

import os
import time

from pyspark.sql import SparkSession

from quillon.operators import k2
from quillon.sources.matrices import bernoulli_matrix


def timed(spark, m: int, n: int, u: int) -> tuple[float, float, int]:
    matrix = bernoulli_matrix(spark, m, n, 0.9, seed=42)
    began = time.time()
    weighted = k2.compressed(matrix, n)
    counted = time.time()
    found = k2.k2(weighted.select("v"), n, u=u) if weighted.count() == m else k2.k2(matrix, n, u=u)
    edges = found.where("step > 0").count()
    return counted - began, time.time() - counted, edges


def main() -> None:
    numbers = lambda name, default: [int(x) for x in os.environ.get(name, default).split(",")]
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    print("features,rows,parents,cpus,count_s,search_s,edges", flush=True)
    for u in numbers("SWEEP_PARENTS", "2"):
        for n in numbers("SWEEP_FEATURES", "10,20,40,100"):
            for m in numbers("SWEEP_ROWS", "100,10000"):
                timed(spark, m, n, u)
                count, search, edges = timed(spark, m, n, u)
                print(f"{n},{m},{u},{cpus},{count:.3f},{search:.3f},{edges}", flush=True)


if __name__ == "__main__":
    main()
