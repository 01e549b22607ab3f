"""The queries of this package: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from siltstone.llm.audit import OP13_SQL, op13_filter_audit
from siltstone.llm.compression import OP11_SQL, op11_vector_codes
from siltstone.llm.concatenation import op12_concatenation
from siltstone.llm.language import op8_language
from siltstone.llm.mixing import op6_mixing
from siltstone.llm.packing import op1_packing
from siltstone.llm.pii import op7_pii
from siltstone.llm.quality import OP10_SQL, op10_quality
from siltstone.llm.simhash import op3_simhash
from siltstone.llm.substrings import OP2_SQL, op2_substrings
from siltstone.llm.toxicity import op4_toxicity
from siltstone.llm.urls import OP9_SQL, op9_urls
from siltstone.llm.vectors import OP5_SQL, op5_vectors

QUERIES = {
    "op1_packing": op1_packing,
    "op2_substrings": op2_substrings,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_vectors": op5_vectors,
    "op6_mixing": op6_mixing,
    "op7_pii": op7_pii,
    "op8_language": op8_language,
    "op9_urls": op9_urls,
    "op10_quality": op10_quality,
    "op11_vector_codes": op11_vector_codes,
    "op12_concatenation": op12_concatenation,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES = {
    "op2_substrings": OP2_SQL,
    "op5_vectors": OP5_SQL,
    "op9_urls": OP9_SQL,
    "op10_quality": OP10_SQL,
    "op11_vector_codes": OP11_SQL,
    "op13_filter_audit": OP13_SQL,
}
