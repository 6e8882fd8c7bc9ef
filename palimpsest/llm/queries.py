"""The registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from .decontaminate import op3_benchmark_decontamination
from .embeddings import op6_embedding_near_dedup, vectors_sql
from .jaccard import op5_ngram_jaccard_join, pairs_sql
from .langid import op1_language_id
from .lines import op10_line_dedup, runs_sql
from .mixing import op2_source_mixing
from .pii import op4_pii_pseudonyms
from .substrings import intervals_sql, op9_substring_dedup
from .toxicity import op7_toxicity
from .urlrep import op8_url_reputation, reputation_sql

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_source_mixing,
        op3_benchmark_decontamination,
        op4_pii_pseudonyms,
        op5_ngram_jaccard_join,
        op6_embedding_near_dedup,
        op7_toxicity,
        op8_url_reputation,
        op9_substring_dedup,
        op10_line_dedup,
    )
}
ORACLES = {
    "op5_ngram_jaccard_join": pairs_sql(),
    "op6_embedding_near_dedup": vectors_sql(),
    "op8_url_reputation": reputation_sql(),
    "op9_substring_dedup": intervals_sql(),
    "op10_line_dedup": runs_sql(),
}
