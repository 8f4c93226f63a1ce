"""The queries of this subpackage, for the entry module."""
from . import avi, bagminhash, imatch, mixing, packing, repeats, tokens, toxicity

QUERIES = {f.__name__: f for f in (
    tokens.op1_huffman_ids, avi.op2_avi, bagminhash.op3_bagminhash, toxicity.op4_toxicity, packing.op5_best_fit_packing, mixing.op6_curriculum_mix,
    repeats.op7_substring_dedup, imatch.op8_imatch, tokens.op9_token_counts, repeats.op10_suffix_array_dedup)}
ORACLES: dict[str, str] = {}
