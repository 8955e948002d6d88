"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tessera.operators import graph, lexical, semantic
from tessera.plans import catalog
from tessera.plans.engine import CodeIndex

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Twenty stated queries: words of the tables' languages, names and phrases.
ASKED = {i: q for i, q in enumerate("the idiot ndthe license version und die der eau ción thing tion ereth onble thandthe scum heit ment adoos worthless".split())}


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    out: dict[str, float] = {}
    lines = lexical.lines(catalog.files(spark, SF_DIR))
    out["lines_build_cold"] = timed(lambda: noop(lines))
    out["lines_build"] = timed(lambda: noop(lines))
    exact = {q: (p, "exact") for q, p in ASKED.items()}
    out["search_20_exact"] = timed(lambda: noop(lexical.search_many(lines, exact)))
    index = semantic.build(lines)
    out["term_index_build"] = timed(lambda: noop(index.terms))
    own, calls = catalog.text_symbols(lines, 4)
    out["symbols_and_edges"] = timed(lambda: noop(graph.resolve_calls(calls, own)))
    holder: dict[str, CodeIndex] = {}
    out["open_index"] = timed(lambda: holder.update(index=CodeIndex.from_files(spark, catalog.files(spark, SF_DIR))))
    opened = holder["index"]
    asked = semantic.query_frame(spark, ASKED)
    out["semantic_20_top100_cold"] = timed(lambda: noop(semantic.cosine_search(opened._index(), asked)))
    out["semantic_20_top100"] = timed(lambda: noop(semantic.cosine_search(opened._index(), asked)))
    out["stored_search_20_exact"] = timed(lambda: noop(lexical.search_many(opened.lines, exact)))
    out["callers_depth_3"] = timed(lambda: noop(catalog.QUERIES["callers_upto_3"](spark, SF_DIR)))
    out["context_plan_20_cold"] = timed(lambda: noop(opened.plan_contexts(ASKED)))
    out["context_plan_20"] = timed(lambda: noop(opened.plan_contexts(ASKED)))
    out["context_plan_20_semantic"] = timed(lambda: noop(opened.plan_contexts(ASKED, semantic_leg=True)))
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
