"""Plans over tables of names."""

from onomast.operators.components import components
from onomast.operators.dedupe import dedupe
from onomast.operators.frequency import block_sizes, parse_stats, surname_frequency
from onomast.operators.match_join import candidates, match_join, match_pairs, probe, self_pairs
from onomast.operators.tokens import name_tokens

__all__ = [
    "block_sizes", "candidates", "components", "dedupe", "match_join", "match_pairs", "name_tokens", "parse_stats", "probe",
    "self_pairs", "surname_frequency",
]
