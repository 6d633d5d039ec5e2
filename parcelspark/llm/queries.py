"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from functools import wraps

from ..functions.shipping import ship
from .packing import op5_curve_packing
from .alignment import op13_group_dictionary
from .ann import op6_multi_index
from .lexical import SQL as LEXICAL_SQL
from .lexical import op12_block_max_wand
from .lineqc import SQL as LINE_SQL
from .lineqc import op4_line_frequency
from .mixing import op10_source_mix
from .neardup import op3_bottom_k_dedup
from .ngrams import op9_kneser_ney
from .prefixtree import op11_prefix_tree_join
from .sharding import op7_hilbert_shards
from .quality import op2_rule_quality
from .tokenstore import op8_token_store
from .toxicity import op1_toxicity_grammar


def _shipped(f):
    return wraps(f)(lambda spark, sf_dir: f(ship(spark), sf_dir))


QUERIES = {
    f.__name__: _shipped(f)
    for f in (
        op1_toxicity_grammar, op2_rule_quality, op3_bottom_k_dedup, op4_line_frequency, op5_curve_packing, op6_multi_index, op7_hilbert_shards,
        op8_token_store, op9_kneser_ney, op10_source_mix, op11_prefix_tree_join, op12_block_max_wand, op13_group_dictionary,
    )
}
ORACLE_SQL: dict[str, str] = {"op4_line_frequency": LINE_SQL, "op12_block_max_wand": LEXICAL_SQL}
