"""Times headline queries on the given tables and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Every query's whole
result is computed into a sink that keeps nothing."""

import json
import os
import time

from mediaplan.session import local_session
import workload

QUERIES = """R5_rank_for_slot R4_slot_reasons R5_rank_all R8_best_window Q5_flow_stats Q12_window_motion Q13_smooth_same
Q14_freeze_spans S3_normalize_spans S7_near_scenes S7_similar_looks V1_merge_spans V8_weighted_overlap V9_scene_at
L1_parse_reply L2_apply_annotations M1_energy_curve M6_cut_points M8_music_cue I5_upsert I9_flatten_probe
P3_snap_to_cuts P7_replacement_candidates T7_crossfade_timeline T8_render_backlog C3_mark_used C9_toggle_flags
Z2_lane_zones Z6_solve_timing W4_freeze_episodes""".split()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="16g")
    queries = workload.queries()
    queries["C1_list_scenes"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    times = {}
    for name in os.environ.get("BENCH_QUERIES", " ".join(QUERIES)).split():
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
