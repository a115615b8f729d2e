"""The operators' queries and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from .anisotropic_ann import op5_anisotropic_ann
from .collocations import ORACLE as OP11_ORACLE
from .collocations import op11_collocations
from .divergence import ORACLE as OP13_ORACLE
from .divergence import op13_source_divergence
from .exact_dedup import ORACLE as OP12_ORACLE
from .exact_dedup import op12_exact_dedup
from .html_extract import op8_html_extract
from .jaccard_join import op2_jaccard_join
from .language_id import op6_language_id
from .max_score import ORACLE as OP7_ORACLE
from .max_score import op7_max_score
from .mixing import ORACLE as OP3_ORACLE
from .mixing import op3_mixing
from .piece_sampling import op9_piece_sampling
from .quality import op4_quality
from .suffix_dedup import op1_suffix_dedup
from .toxicity import op10_toxicity

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_anisotropic_ann": op5_anisotropic_ann,
    "op6_language_id": op6_language_id,
    "op7_max_score": op7_max_score,
    "op8_html_extract": op8_html_extract,
    "op9_piece_sampling": op9_piece_sampling,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_source_divergence": op13_source_divergence,
}
ORACLES: dict[str, str] = {
    "op3_mixing": OP3_ORACLE,
    "op7_max_score": OP7_ORACLE,
    "op11_collocations": OP11_ORACLE,
    "op12_exact_dedup": OP12_ORACLE,
    "op13_source_divergence": OP13_ORACLE,
}
