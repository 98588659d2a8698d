"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from barloom.llm.bpe import op3_byte_bpe
from barloom.llm.decontaminate import op5_decontaminate
from barloom.llm.license_scan import OP12_SQL, op12_license_scan
from barloom.llm.lines import op7_line_dedup
from barloom.llm.near import op10_near_dedup
from barloom.llm.preferences import OP6_SQL, op6_preference_pairs
from barloom.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from barloom.llm.quality_model import op9_quality
from barloom.llm.quality_rules import OP8_SQL, op8_quality_rules
from barloom.llm.ranked_search import OP11_SQL, op11_ranked_search
from barloom.llm.repeats import OP4_SQL, op4_substring_dedup
from barloom.llm.token_files import op2_token_counts
from barloom.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_preference_pairs": op6_preference_pairs,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_quality": op9_quality,
    "op10_near_dedup": op10_near_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_license_scan": op12_license_scan,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL = {
    "op4_substring_dedup": OP4_SQL,
    "op6_preference_pairs": OP6_SQL,
    "op8_quality_rules": OP8_SQL,
    "op11_ranked_search": OP11_SQL,
    "op12_license_scan": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
