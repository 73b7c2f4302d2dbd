"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .conversation_trie import OP12_SQL, op12_conversation_trie
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .language import op3_language
from .language_model import op6_language_model
from .mixing import OP10_SQL, op10_mixing
from .neighbours import op7_neighbours
from .packing import op5_packing
from .secrets import op8_secret_scan
from .simhash import op1_simhash
from .token_counts import op2_token_counts
from .token_output import op4_token_output
from .toxicity import op11_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_token_counts": op2_token_counts,
    "op3_language": op3_language,
    "op4_token_output": op4_token_output,
    "op5_packing": op5_packing,
    "op6_language_model": op6_language_model,
    "op7_neighbours": op7_neighbours,
    "op8_secret_scan": op8_secret_scan,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_mixing": op10_mixing,
    "op11_toxicity": op11_toxicity,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op9_exact_dedup": OP9_SQL,
    "op10_mixing": OP10_SQL,
    "op12_conversation_trie": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
