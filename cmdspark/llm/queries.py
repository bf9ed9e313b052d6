"""Queries and SQL of this subpackage, for the entry module to add."""

from __future__ import annotations

from .chat import OP4_SQL, op4_format_chats
from .clustering import OP11_SQL, op11_centroid_clusters
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .langid import op5_language_id
from .media import op2_media_columns
from .minhash import op7_near_dedup
from .mixing import op9_mix_sources
from .packing import op3_pack_documents
from .quality import OP13_SQL, op13_quality_rules
from .runs import op12_periodic_runs
from .toxicity import op8_toxicity
from .url_filter import op10_filter_urls
from .warc import OP6_SQL, op6_arc_to_warc

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_media_columns": op2_media_columns,
    "op3_pack_documents": op3_pack_documents,
    "op4_format_chats": op4_format_chats,
    "op5_language_id": op5_language_id,
    "op6_arc_to_warc": op6_arc_to_warc,
    "op7_near_dedup": op7_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_mix_sources": op9_mix_sources,
    "op10_filter_urls": op10_filter_urls,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quality_rules": op13_quality_rules,
}
SQL = {"op1_exact_dedup": OP1_SQL, "op4_format_chats": OP4_SQL, "op6_arc_to_warc": OP6_SQL, "op11_centroid_clusters": OP11_SQL, "op13_quality_rules": OP13_SQL}
