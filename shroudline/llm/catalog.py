"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chroma import op3_chroma
from .codes import OP13_SQL, op13_codes
from .language import op10_language
from .metric import OP12_SQL, op12_metric
from .packing import op8_packing
from .pieces import op6_sentencepiece
from .pii import op1_pii
from .quality import op5_quality
from .ranked import OP11_SQL, op11_ranked
from .rollups import OP2_SQL, op2_rollups
from .simhash import op7_simhash
from .substrings import op9_substrings
from .toxicity import op4_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_rollups": op2_rollups,
    "op3_chroma": op3_chroma,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_substrings": op9_substrings,
    "op10_language": op10_language,
    "op11_ranked": op11_ranked,
    "op12_metric": op12_metric,
    "op13_codes": op13_codes,
}

ORACLE_SQL: dict[str, str] = {"op2_rollups": OP2_SQL, "op11_ranked": OP11_SQL, "op12_metric": OP12_SQL, "op13_codes": OP13_SQL}
