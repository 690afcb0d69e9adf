"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from tracemill.plans import catalog
from tracemill.session import local_session

HEADLINE = ["q_calc_verify", "q_calc_extract", "q_calc_eval_udf", "q_plan_dsl", "q_verify_claims", "q_verdict_confusion", "q_eval_grouping_sets", "q_chain_hist", "q_split_train_val", "q_stratified_rr", "q_largest_remainder", "q_last_wins", "q_merge_roles", "q_resume_anti", "q_dedup_exact", "q_chat_io", "q_ws_norm", "q_collapse_lines", "q_multistep", "q_qc_reasons", "q_router_calls", "q_answer_sets", "q_answer_expressions", "q_repair_rows", "q_perturb", "q_provenance", "q_planner_quality", "q_caps_in_a_column", "q_padded_batches"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            began = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(min(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
