"""The registered queries of the subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from .decontaminate import op2_greedy_tiling
from .fim import SQL as FIM_SQL
from .fim import op13_boundary_sets
from .katz import op3_katz_backoff
from .licences import op4_diagonal_voting
from .mixing import SQL as MIXING_SQL
from .mixing import op11_source_schedule
from .neardup import op10_tensored_minhash
from .packing import op7_best_fit_packing
from .pii import op9_contextual_pii
from .quality import op1_quality_cascade
from .sharding import op5_sampled_splitters
from .tokens import op6_token_counts
from .urls import op8_path_templates
from .whitening import op12_refined_whitening

QUERIES = {f.__name__: f for f in (
    op1_quality_cascade, op2_greedy_tiling, op3_katz_backoff, op4_diagonal_voting, op5_sampled_splitters, op6_token_counts,
    op7_best_fit_packing, op8_path_templates, op9_contextual_pii, op10_tensored_minhash,
    op11_source_schedule, op12_refined_whitening, op13_boundary_sets)}
ORACLES: dict[str, str] = {"op11_source_schedule": MIXING_SQL, "op13_boundary_sets": FIM_SQL}
