"""The queries of this folder, as __spark_entry__.py registers them."""

from __future__ import annotations

from . import langid, mixing, pieces, pii, repeats, repetition, sharding, simhash, tokenfile, topk

QUERIES = {
    "op1_differencing": sharding.op1_differencing,
    "op2_nra": topk.op2_nra,
    "op3_suffix_levels": repeats.op3_suffix_levels,
    "op4_repetition": repetition.op4_repetition,
    "op5_centroids": langid.op5_centroids,
    "op6_mixing": mixing.op6_mixing,
    "op7_simhash": simhash.op7_simhash,
    "op8_field": pii.op8_field,
    "op9_direct": tokenfile.op9_direct,
    "op10_pieces": pieces.op10_pieces,
}
#: The other queries are tested against brute force in tests/llm.
ORACLES = {"op2_nra": topk.OP2_SQL, "op6_mixing": mixing.OP6_SQL}
