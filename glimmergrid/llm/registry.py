"""Queries of this subpackage, and their SQL twins."""

from glimmergrid.llm import fingerprints, hard_negatives, jaccard, language, line_dedup, mixing, neighbours, packing, prefix_trie, quality, suffix_dedup, tiers, toxicity

QUERIES = {
    "op10_neighbours": neighbours.op10_neighbours,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op6_jaccard": jaccard.op6_jaccard,
    "op5_language": language.op5_language,
    "op1_quality": quality.op1_quality,
    "op4_toxicity": toxicity.op4_toxicity,
    "op7_packing": packing.op7_packing,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_mixing": mixing.op9_mixing,
    "op11_negatives": hard_negatives.op11_negatives,
    "op12_tiers": tiers.op12_tiers,
    "op13_trie": prefix_trie.op13_trie,
}

ORACLES = {
    "op6_jaccard": jaccard.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op11_negatives": hard_negatives.ORACLE,
    "op13_trie": prefix_trie.ORACLE,
}
