"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papyrine.llm import twins
from papyrine.llm.bpe import op3_bpe
from papyrine.llm.decontaminate import op5_decontaminate
from papyrine.llm.language import op8_language
from papyrine.llm.linededup import op9_linededup
from papyrine.llm.nearest import op10_nearest
from papyrine.llm.neardup import op7_neardup
from papyrine.llm.pii import op6_pii
from papyrine.llm.quality import op1_quality
from papyrine.llm.resampling import op11_resampling
from papyrine.llm.substrings import op2_substrings
from papyrine.llm.suffixes import op12_suffixes
from papyrine.llm.toxicity import op4_toxicity
from papyrine.llm.whitening import op13_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_substrings": op2_substrings,
    "op3_bpe": op3_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_decontaminate": op5_decontaminate,
    "op6_pii": op6_pii,
    "op7_neardup": op7_neardup,
    "op8_language": op8_language,
    "op9_linededup": op9_linededup,
    "op10_nearest": op10_nearest,
    "op11_resampling": op11_resampling,
    "op12_suffixes": op12_suffixes,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = twins.ORACLES
