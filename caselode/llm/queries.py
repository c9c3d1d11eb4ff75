"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from caselode.llm.collocations import OP13_SQL, op13_collocations
from caselode.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from caselode.llm.fingerprints import op8_fingerprints
from caselode.llm.licenses import OP2_SQL, op2_licenses
from caselode.llm.lm import op1_lm_scoring
from caselode.llm.near_dedup import op10_near_dedup
from caselode.llm.packing import op3_packing
from caselode.llm.pii import op7_pii
from caselode.llm.ranked_search import OP11_SQL, op11_ranked_search
from caselode.llm.segmentation import op4_segmentation
from caselode.llm.simhash import op12_simhash
from caselode.llm.substring_dedup import op5_substring_dedup
from caselode.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_licenses": op2_licenses,
    "op3_packing": op3_packing,
    "op4_segmentation": op4_segmentation,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_pii": op7_pii,
    "op8_fingerprints": op8_fingerprints,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_near_dedup": op10_near_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_simhash": op12_simhash,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL = {
    "op2_licenses": OP2_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_ranked_search": OP11_SQL,
    "op13_collocations": OP13_SQL,
}
