"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from querent.llm.alignment import op13_alignment
from querent.llm.decontaminate import OP8_SQL, op8_decontamination
from querent.llm.embedding_dedup import op12_embedding_dedup
from querent.llm.language_id import op9_language_id
from querent.llm.media_columns import op3_media_columns
from querent.llm.merkle import OP11_SQL, op11_merkle
from querent.llm.minhash_dedup import OP2_SQL, op2_minhash_dedup
from querent.llm.packing import op5_packing
from querent.llm.run_length_dedup import OP10_SQL, op10_run_length_dedup
from querent.llm.sharding import op7_sharding
from querent.llm.substring_dedup import OP4_SQL, op4_substring_dedup
from querent.llm.token_counts import op6_token_counts
from querent.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_media_columns": op3_media_columns,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_packing": op5_packing,
    "op6_token_counts": op6_token_counts,
    "op7_sharding": op7_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_language_id": op9_language_id,
    "op10_run_length_dedup": op10_run_length_dedup,
    "op11_merkle": op11_merkle,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_alignment": op13_alignment,
}

#: The rest can't be put in SQL: containers, tokenizers and learned models. Tests compare them with brute force.
ORACLES: dict[str, str] = {"op2_minhash_dedup": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op8_decontamination": OP8_SQL, "op10_run_length_dedup": OP10_SQL, "op11_merkle": OP11_SQL}
