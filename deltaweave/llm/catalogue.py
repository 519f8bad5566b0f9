"""The registered queries of this subpackage."""

from deltaweave.llm import byte_bpe, embedding_dedup, exact_dedup, jaccard_join, oracles, packing, pii, secrets, substring_dedup, token_store, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_token_store": token_store.op3_token_store,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_pii": pii.op9_pii,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_embedding_dedup": oracles.EMBEDDINGS,
    "op7_substring_dedup": oracles.SUBSTRINGS,
    "op10_jaccard_join": oracles.JACCARD,
}
