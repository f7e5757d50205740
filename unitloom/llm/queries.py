"""The queries of this folder, each with its SQL where SQL can express it."""

from __future__ import annotations

import corpus_pipeline
from unitloom.llm import (
    alignment, block_naming, chat_format, jaccard, line_dedup, merkle, packing, pieces, quality, sanitise, substring_dedup, topk_search, toxicity,
)

#: name -> (query, SQL or None)
LLM_QUERIES = {
    "op1_topk_search": (topk_search.op1_topk_search, topk_search.SQL),
    "op2_toxicity": (toxicity.op2_toxicity, None),
    "op3_chat_format": (chat_format.op3_chat_format, chat_format.SQL),
    "op4_exact_dedup": (block_naming.op4_exact_dedup, block_naming.SQL),
    "op5_pii": (sanitise.op5_pii, None),
    "op6_substring_dedup": (substring_dedup.op6_substring_dedup, substring_dedup.SQL),
    "op7_sentencepiece": (pieces.op7_sentencepiece, None),
    "op8_line_dedup": (line_dedup.op8_line_dedup, line_dedup.SQL),
    "op9_bestfit_packing": (packing.op9_bestfit_packing, None),
    "op10_jaccard_join": (jaccard.op10_jaccard_join, jaccard.SQL),
    "op11_merkle_manifest": (merkle.op11_merkle_manifest, merkle.SQL),
    "op12_quality_classifier": (quality.op12_quality_classifier, None),
    "op13_tokenizer_alignment": (alignment.op13_tokenizer_alignment, None),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
