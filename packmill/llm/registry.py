"""The subpackage's queries, and DuckDB SQL for those that SQL can express."""

from packmill.llm import decontaminate, mixing, quality, sharding, simhash, tokenfile, topk, toxicity, urls, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_mixing": mixing.op2_mixing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_urls": urls.op4_urls,
    "op5_quality": quality.op5_quality,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_sharding": sharding.op7_sharding,
    "op8_warc": warc.op8_warc,
    "op9_tokens": tokenfile.op9_tokens,
    "op10_topk": topk.op10_topk,
}

SQL = {
    "op4_urls": urls.OP4_SQL,
    "op7_sharding": sharding.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op10_topk": topk.OP10_SQL,
}
