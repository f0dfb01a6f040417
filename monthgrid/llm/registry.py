"""The queries of the corpus operators and their SQL twins."""

from __future__ import annotations

import corpus_pipeline

from . import decontam, langid, lines, negatives, nndescent, partenum, pieces, prefixtrie, quality, suffix, toxicity, urlfilter, warc

QUERIES = {
    "op1_decontamination": decontam.op1,
    "op2_suffix_array_dedup": suffix.op2,
    "op3_line_dedup": lines.op3,
    "op4_sentencepiece": pieces.op4,
    "op5_language_id": langid.op5,
    "op6_ngram_jaccard": partenum.op6,
    "op7_toxicity": toxicity.op7,
    "op8_warc": warc.op8,
    "op9_embedding_dedup": nndescent.op9,
    "op10_url_filter": urlfilter.op10,
    "op11_prefix_trie": prefixtrie.op11,
    "op12_hard_negatives": negatives.op12,
    "op13_quality_rules": quality.op13,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_decontamination": decontam.SQL,
    "op3_line_dedup": lines.SQL,
    "op6_ngram_jaccard": partenum.SQL,
    "op8_warc": warc.SQL,
    "op9_embedding_dedup": nndescent.SQL,
    "op10_url_filter": urlfilter.SQL,
    "op11_prefix_trie": prefixtrie.SQL,
    "op12_hard_negatives": negatives.SQL,
    "op13_quality_rules": quality.SQL,
}
