"""Seconds per headline query on the example tables, as one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and cores.  Every query writes all of its rows to the no-op sink.
"""

from __future__ import annotations

import json
import os
import time

from gridspark.plans import QUERIES
from gridspark.session import local_session

HEADLINE = (
    "match_quality",
    "nearest_match",
    "ordered_dither",
    "tile_palette_match",
    "closest_pair",
    "fidelity",
    "rgb_to_oklab",
    "chroma_boost",
    "color_histogram",
    "otsu_threshold",
    "dither_strength",
    "detail_map",
    "gaussian_blur",
    "median_filter",
    "filter_requantize",
    "polygon_select",
    "dilate",
    "erode",
    "remap",
    "xor_undelta",
    "sparse_apply",
    "skip_thin",
    "frame_clock",
    "chunk_explode",
    "chunk_assemble",
    "segment_assemble",
    "channel_split",
    "tile_stats",
    "batch_status",
    "plan_vs_actual",
    "unbuilt",
    "demand",
    "latest_stock",
    "nearest_source",
    "serpentine_order",
    "capped_load",
    "proportional_slots",
    "history_top",
    "page",
    "components_equal",
    "reduce_palette",
    "stream_group_assemble",
)


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, **{"spark.log.level": "OFF"})
    spark.sparkContext.setLogLevel("OFF")
    run(spark, folder, "match_quality")  # start the JVM's and Python's workers
    times = {name: round(run(spark, folder, name), 3) for name in HEADLINE}
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cores": int(cores),
        "spark": spark.version,
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
