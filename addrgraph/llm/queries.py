"""Registered queries of this subpackage and their DuckDB twins."""

from .dedup import ORACLE_OP1, op1_grace_hash_dedup
from .merkle import ORACLE_OP11, op11_octopus_manifest
from .mixing import op8_block_mix
from .packing import op5_bound_certified_packing
from .phrases import ORACLE_OP13, op13_phrase_automata
from .prefix_trie import ORACLE_OP12, op12_whole_sequence_trie
from .quality import op9_attention_quality
from .secrets import op3_linked_secrets
from .shards import op4_hypergeometric_shards
from .shingles import op7_count_vector_rtree
from .suffixes import op2_sharded_suffix_arrays
from .token_counts import op6_digest_cache_counts
from .vectors import op10_projection_forest

QUERIES = {f.__name__: f for f in (
    op1_grace_hash_dedup, op2_sharded_suffix_arrays, op3_linked_secrets, op4_hypergeometric_shards,
    op5_bound_certified_packing, op6_digest_cache_counts, op7_count_vector_rtree, op8_block_mix, op9_attention_quality,
    op10_projection_forest, op11_octopus_manifest,
    op12_whole_sequence_trie, op13_phrase_automata)}
#: The other queries depend on hashes, draws or models that SQL does not have, or reach a
#: closure or packing that it cannot express on whole tables; tests/llm holds them against brute force.
ORACLES = {"op1_grace_hash_dedup": ORACLE_OP1, "op11_octopus_manifest": ORACLE_OP11,
           "op12_whole_sequence_trie": ORACLE_OP12, "op13_phrase_automata": ORACLE_OP13}
