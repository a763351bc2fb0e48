"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .alignment import op11_tokenizer_alignment
from .annscan import op12_nearest_neighbours
from .chat import OP6_SQL, op6_chat_perspectives
from .linededup import OP10_SQL, op10_line_dedup
from .minhash import op5_minhash_near_dedup
from .mixing import OP8_SQL, op8_mixing
from .neargraph import OP9_SQL, op9_embedding_near_dedup
from .packing import op2_best_fit_packing
from .pii import OP4_SQL, op4_pii
from .quality import op7_quality_classifier
from .sharding import op3_jump_sharding
from .topk import OP1_SQL, op1_exact_top_k
from .whitening import op13_embedding_whitening

QUERIES = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_jump_sharding": op3_jump_sharding,
    "op4_pii": op4_pii,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_chat_perspectives": op6_chat_perspectives,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_mixing": op8_mixing,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_embedding_whitening": op13_embedding_whitening,
}

SQL: dict[str, str] = {
    "op1_exact_top_k": OP1_SQL,
    "op4_pii": OP4_SQL,
    "op6_chat_perspectives": OP6_SQL,
    "op8_mixing": OP8_SQL,
    "op9_embedding_near_dedup": OP9_SQL,
    "op10_line_dedup": OP10_SQL,
}
