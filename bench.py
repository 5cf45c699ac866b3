"""Times the headline queries and prints one JSON line.

Every query is run once to warm the JVM and once for the clock; its whole result is
computed both times (written to the no-op sink).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from checks import queries as Q
from tablefacts.operators.kpi import compute_kpis
from tablefacts.operators.profile import profile_table
from tablefacts.session import configure

KPI_BATCH = [
    Q.extreme("Top flag", "l_returnflag", "l_extendedprice"),
    Q.average("Mean per flag", "l_returnflag", "l_extendedprice"),
    Q.rate("Open", "l_linestatus", "o"),
]

HEADLINE = {
    "profile_lineitem": lambda s, d: profile_table(Q.read(s, d, "lineitem"), "lineitem"),
    "profile_documents": lambda s, d: profile_table(Q.read(s, d, "documents"), "documents"),
    "profile_workspace": Q.workspace_profile,
    "kpi_batch_lineitem": lambda s, d: compute_kpis(Q.read(s, d, "lineitem"), KPI_BATCH),
    "kpi_peak_point": Q.QUERIES["kpi_peak_point"],
    "kpi_filtered_text": Q.QUERIES["kpi_filtered_text"],
    "facts_sum": Q.QUERIES["facts_sum"],
    "facts_many_categories": Q.QUERIES["facts_numbers"],
    "top_values": Q.QUERIES["frequent_values"],
    "series_bar": Q.QUERIES["series_bar"],
    "series_line_mean": Q.QUERIES["series_line_mean"],
    "table_cells": Q.QUERIES["table_cells"],
    "spec_parse": Q.QUERIES["spec_parse"],
    "load_text_table": Q.QUERIES["load_text_table"],
    "run_kpis": Q.QUERIES["run_kpis"],
    "run_series": Q.QUERIES["run_series"],
}


def consume(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablefacts-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, query in HEADLINE.items():
        consume(query(spark, sf_dir))
        start = time.perf_counter()
        consume(query(spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
