"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .backoff_lm import op10_backoff_lm
from .html_density import op5_html_density
from .licenses import op7_licenses
from .line_crf import op3_quality_rules
from .packing import op4_packing
from .phrase_prints import op9_phrase_prints
from .quality_knn import op6_quality_knn
from .sentencepiece_codec import op1_sentencepiece
from .simhash import op8_simhash
from .token_files import op2_token_files

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_files": op2_token_files,
    "op3_quality_rules": op3_quality_rules,
    "op4_packing": op4_packing,
    "op5_html_density": op5_html_density,
    "op6_quality_knn": op6_quality_knn,
    "op7_licenses": op7_licenses,
    "op8_simhash": op8_simhash,
    "op9_phrase_prints": op9_phrase_prints,
    "op10_backoff_lm": op10_backoff_lm,
}

#: Each of these needs a tokenizer, a fitted model, a parser or a hash that DuckDB lacks; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {}
