"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from terrafold.operators import carbon
from terrafold.plans import queries as q
from terrafold.plans.fixtures import Layers

YEARS = 34
HEADLINE = ("crop_pet_grid", "yield_grid", "zonal_stats", "area_weighted_stats", "scenario_report")


def carbon_run(layers: Layers):
    """The carbon fold over all cells for 34 years."""
    return carbon.annual_blocks(q.packed(layers, n=YEARS), ["cell_id"])


def seconds(df) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    layers = Layers(spark, sf_dir)
    seconds(layers.cells.select(F.sum("soc0")))  # starts the session's threads and compiles the first plan
    took = {"carbon_annual_34_years": seconds(carbon_run(layers))}
    for name in HEADLINE:
        began = time.perf_counter()
        df = q.QUERIES[name](spark, sf_dir)
        took[name] = round(time.perf_counter() - began + seconds(df), 3)
    cells = layers.cells.count()
    total = round(sum(took.values()), 3)
    print(json.dumps({
        "metric": "headline_total", "value": total, "unit": "sec", "queries": took, "sf": Path(sf_dir).name, "cpus": int(cpus),
        "cell_months_per_s": round(cells * YEARS * 12 / took["carbon_annual_34_years"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
