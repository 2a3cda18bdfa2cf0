"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tallgrass.llm import ann, ego, minhash, mixing, sharding
from tallgrass.llm.ann import op5_nearest
from tallgrass.llm.ego import op6_linked
from tallgrass.llm.minhash import op8_minhash
from tallgrass.llm.mixing import op2_mixing
from tallgrass.llm.packing import op9_packing
from tallgrass.llm.sharding import op7_sharding
from tallgrass.llm.suffixes import op4_suffixes
from tallgrass.llm.token_counts import op3_token_counts
from tallgrass.llm.token_files import op1_token_files
from tallgrass.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_mixing": op2_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_suffixes": op4_suffixes,
    "op5_nearest": op5_nearest,
    "op6_linked": op6_linked,
    "op7_sharding": op7_sharding,
    "op8_minhash": op8_minhash,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": mixing.sql(),
    "op5_nearest": ann.sql(),
    "op6_linked": ego.sql(),
    "op7_sharding": sharding.sql(),
    "op8_minhash": minhash.sql(),
}
