"""The registered queries of this subpackage and the SQL twins of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import OP3_SQL, op3_exact_dedup
from .filter_audit import OP12_SQL, op12_filter_audit
from .fingerprints import op13_fingerprints
from .license_scan import op8_license_scan
from .minhash_dedup import OP1_SQL, op1_minhash_dedup
from .mixing import op5_mix_sources
from .mtree_search import OP10_SQL, op10_mtree_topk
from .pii_crf import op4_pii_crf
from .quality import op7_quality_classifier
from .ranked_search import OP11_SQL, op11_ranked_search
from .secret_scan import op2_secret_scan
from .sentencepiece_bpe import op9_sentencepiece
from .substring_dedup import OP6_SQL, op6_substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_pii_crf": op4_pii_crf,
    "op5_mix_sources": op5_mix_sources,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_license_scan": op8_license_scan,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_mtree_topk": op10_mtree_topk,
    "op11_ranked_search": op11_ranked_search,
    "op12_filter_audit": op12_filter_audit,
    "op13_fingerprints": op13_fingerprints,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": OP1_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op10_mtree_topk": OP10_SQL,
    "op11_ranked_search": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}
