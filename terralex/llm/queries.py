"""The registered queries of the training-data operators."""

from __future__ import annotations

from terralex.llm import (
    conversation_repair,
    decontamination,
    embeddings,
    hard_negatives,
    language_model,
    mixing,
    multiprobe,
    pii,
    quality,
    sharding,
    simhash,
    tokencount,
    toxicity,
)

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_tokens": tokencount.op2_tokens,
    "op3_shard": sharding.op3_shard,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_simhash": simhash.op5_simhash,
    "op6_language_model": language_model.op6_language_model,
    "op7_embeddings": embeddings.op7_embeddings,
    "op8_quality": quality.op8_quality,
    "op9_pii": pii.op9_pii,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_nearest": multiprobe.op12_nearest,
    "op13_conversations": conversation_repair.op13_conversations,
}

#: Queries that SQL can express over whole tables; the others have brute-force tests.
ORACLES = {
    "op7_embeddings": embeddings.OP7_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op13_conversations": conversation_repair.OP13_SQL,
}
