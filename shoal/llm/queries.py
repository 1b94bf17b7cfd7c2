"""The registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from shoal.llm import chat, decontam, exact, langid, lm, mixing, periodic, pii, sharding, simhash, suffix, toxicity, whitening

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_exact_dedup": exact.op2_exact_dedup,
    "op3_language_id": langid.op3_language_id,
    "op4_pii": pii.op4_pii,
    "op5_decontamination": decontam.op5_decontamination,
    "op6_poisson_mix": mixing.op6_poisson_mix,
    "op7_chat_format": chat.op7_chat_format,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_suffix_dedup": suffix.op9_suffix_dedup,
    "op10_kd_sharding": sharding.op10_kd_sharding,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_lm_scoring": lm.op12_lm_scoring,
    "op13_whitening": whitening.op13_whitening,
}

ORACLE = {
    "op2_exact_dedup": exact.ORACLE_OP2,
    "op6_poisson_mix": mixing.ORACLE_OP6,
    "op7_chat_format": chat.ORACLE_OP7,
}
