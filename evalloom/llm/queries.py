"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, timestamps, url_filters
from .ann_search import op7_ann_search
from .decontamination import op9_decontamination
from .html_extraction import op2_html_extraction
from .language_id import op3_language_id
from .line_dedup import op5_line_dedup
from .lm_scoring import op1_lm_scoring
from .minhash_dedup import op8_minhash_dedup
from .pieces import op11_sentencepiece
from .source_mixing import op4_source_mixing
from .substring_dedup import op10_substring_dedup
from .timestamps import op12_timestamps
from .url_filters import op6_url_filters
from .whitening import op13_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_html_extraction": op2_html_extraction,
    "op3_language_id": op3_language_id,
    "op4_source_mixing": op4_source_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_url_filters": op6_url_filters,
    "op7_ann_search": op7_ann_search,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_timestamps": op12_timestamps,
    "op13_whitening": op13_whitening,
}
ORACLE: dict[str, str] = {
    "op6_url_filters": url_filters.ORACLE,
    "op9_decontamination": decontamination.ORACLE,
    "op12_timestamps": timestamps.ORACLE,
}
