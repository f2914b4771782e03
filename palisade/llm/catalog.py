"""Registered queries of the training-data operators and their SQL counterparts."""

from .decontamination import OP6_SQL, op6_decontamination
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .filter_audit import OP11_SQL, op11_filter_audit
from .importance_resampling import OP13_SQL, op13_importance_resampling
from .jaccard_join import OP2_SQL, op2_ngram_jaccard
from .language_id import op7_language_id
from .packing import op3_best_fit_packing
from .secret_scan import op8_secret_scan
from .sentence_dedup import OP5_SQL, op5_sentence_dedup
from .shortest_packing import op12_shortest_packing
from .suffix_dedup import op9_suffix_dedup
from .toxicity import op4_toxicity
from .url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_toxicity": op4_toxicity,
    "op5_sentence_dedup": op5_sentence_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_secret_scan": op8_secret_scan,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_shortest_packing": op12_shortest_packing,
    "op13_importance_resampling": op13_importance_resampling,
}
#: Packing, learnt models, recursive decoding and byte-wise suffixes have no SQL: their tests compare with brute force.
ORACLE_SQL = {
    "op1_url_filter": OP1_SQL,
    "op2_ngram_jaccard": OP2_SQL,
    "op5_sentence_dedup": OP5_SQL,
    "op6_decontamination": OP6_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
    "op13_importance_resampling": OP13_SQL,
}
