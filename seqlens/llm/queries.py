"""Registered queries of the corpus operators, and their SQL where SQL can
express them."""

from __future__ import annotations

import corpus_pipeline
from seqlens.llm.bpe_codec import op12_bpe_codec
from seqlens.llm.conversation_repair import op11_conversation_repair
from seqlens.llm.jaccard_join import op1_ngram_jaccard_join
from seqlens.llm.decontaminate import op2_benchmark_decontamination
from seqlens.llm.language_id import op9_language_id
from seqlens.llm.licence_scan import op7_licence_scan
from seqlens.llm.merkle_manifest import op13_merkle_manifest
from seqlens.llm.mixing import op4_source_mixing
from seqlens.llm.oracle import ORACLE as SQL
from seqlens.llm.quality_classifier import op10_quality_classifier
from seqlens.llm.quality_rules import op3_quality_rules
from seqlens.llm.repeated_substrings import op8_repeated_substrings
from seqlens.llm.secret_scan import op6_secret_scan
from seqlens.llm.token_rollup import op5_token_counts

QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard_join,
    op2_benchmark_decontamination,
    op3_quality_rules,
    op4_source_mixing,
    op5_token_counts,
    op6_secret_scan,
    op7_licence_scan,
    op8_repeated_substrings,
    op9_language_id,
    op10_quality_classifier,
    op11_conversation_repair,
    op12_bpe_codec,
    op13_merkle_manifest,
)}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLE: dict[str, str] = dict(SQL)
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
