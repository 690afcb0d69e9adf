"""Queries and SQL of this subpackage."""

from tracemill.llm import queries as q

QUERIES = {
    "op1_kd_shards": q.op1_kd_shards,
    "op6_source_mix": q.op6_source_mix,
    "op2_decontaminate": q.op2_decontaminate,
    "op8_jaccard_join": q.op8_jaccard_join,
    "op9_toxicity": q.op9_toxicity,
    "op10_pii": q.op10_pii,
    "op7_quality": q.op7_quality,
    "op3_learned_partitions": q.op3_learned_partitions,
    "op5_perspectives": q.op5_perspectives,
    "op11_spelling": q.op11_spelling,
    "op12_yinyang": q.op12_yinyang,
    "op13_link_trust": q.op13_link_trust,
    "pipeline": q.pipeline,
    "op4_token_counts": q.op4_token_counts,
}
ORACLES: dict[str, str] = {
    "op5_perspectives": q.OP5_SQL,
    "op8_jaccard_join": q.OP8_SQL,
    "op2_decontaminate": q.OP2_SQL,
    "op12_yinyang": q.OP12_SQL,
    "op13_link_trust": q.OP13_SQL,
}
