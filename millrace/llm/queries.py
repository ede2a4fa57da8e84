"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP7_SQL, op7_chat_prefix_targets
from .decontaminate import OP3_SQL, op3_benchmark_decontamination
from .filter_audit import OP13_SQL, op13_filter_interactions
from .html_text import op1_html_layout_text
from .line_crf import op6_line_crf_quality
from .mixing import OP2_SQL, op2_source_mixing
from .periodic_runs import OP11_SQL, op11_periodic_runs
from .secrets import OP5_SQL, op5_secret_scan
from .simhash import op9_simhash_near_dedup
from .suffix_tree import op12_suffix_tree_scores
from .syncmers import op4_closed_syncmers
from .token_counts import op10_token_counts
from .warc_zip import OP8_SQL, op8_warc_zip_packages

QUERIES = {
    "op1_html_layout_text": op1_html_layout_text,
    "op2_source_mixing": op2_source_mixing,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_closed_syncmers": op4_closed_syncmers,
    "op5_secret_scan": op5_secret_scan,
    "op6_line_crf_quality": op6_line_crf_quality,
    "op7_chat_prefix_targets": op7_chat_prefix_targets,
    "op8_warc_zip_packages": op8_warc_zip_packages,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_suffix_tree_scores": op12_suffix_tree_scores,
    "op13_filter_interactions": op13_filter_interactions,
}

ORACLE_SQL: dict[str, str] = {
    "op2_source_mixing": OP2_SQL,
    "op3_benchmark_decontamination": OP3_SQL,
    "op5_secret_scan": OP5_SQL,
    "op7_chat_prefix_targets": OP7_SQL,
    "op8_warc_zip_packages": OP8_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op13_filter_interactions": OP13_SQL,
}
