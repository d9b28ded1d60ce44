"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from .binary_ids import op4_binary_ids
from .bpe import op6_byte_bpe
from .chunking import op1_chunked_media
from .classifier import op8_quality_classifier
from .fill_in_middle import OP11_SQL, op11_fill_in_middle
from .html_text import op7_html_text
from .line_dedup import OP12_SQL, op12_line_dedup
from .packing import op9_best_fit_packing
from .quality_rules import op2_quality_rules
from .resampling import op13_importance_resampling
from .sharding import op3_sharding
from .simhash import op5_simhash_near_dedup
from .url_filter import OP10_SQL, op10_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_chunked_media, op2_quality_rules, op3_sharding, op4_binary_ids, op5_simhash_near_dedup,
        op6_byte_bpe, op7_html_text, op8_quality_classifier, op9_best_fit_packing, op10_url_filter, op11_fill_in_middle, op12_line_dedup, op13_importance_resampling,
    )
}

ORACLE_SQL: dict[str, str] = {"op10_url_filter": OP10_SQL, "op11_fill_in_middle": OP11_SQL, "op12_line_dedup": OP12_SQL}
