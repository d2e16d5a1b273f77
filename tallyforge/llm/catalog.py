"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import merkle, minhash, spelling, spotsigs, substring, topk
from tallyforge.llm.bpe import op4_byte_bpe
from tallyforge.llm.html import op7_html
from tallyforge.llm.langid import op9_language_id
from tallyforge.llm.merkle import op11_merkle
from tallyforge.llm.minhash import op5_minhash
from tallyforge.llm.packing import op1_packing
from tallyforge.llm.pii import op10_pii
from tallyforge.llm.quality import op6_quality
from tallyforge.llm.spelling import op12_spelling
from tallyforge.llm.spotsigs import op8_spotsigs
from tallyforge.llm.substring import op3_substring
from tallyforge.llm.topk import op2_topk
from tallyforge.llm.toxicity import op13_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_topk, op3_substring, op4_byte_bpe, op5_minhash, op6_quality, op7_html, op8_spotsigs, op9_language_id, op10_pii, op11_merkle, op12_spelling, op13_toxicity)}


def oracle_sql() -> dict[str, str]:
    """Those of 2, 3, 5, 8, 11 and 12; the others learn a model, run a tokenizer, draw surrogates or read markup, and are tested."""
    return {"op2_topk": topk.ORACLE, "op3_substring": substring.ORACLE, "op5_minhash": minhash.ORACLE, "op8_spotsigs": spotsigs.ORACLE, "op11_merkle": merkle.ORACLE, "op12_spelling": spelling.ORACLE}
