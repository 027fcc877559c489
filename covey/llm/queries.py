"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import op1_ann, op2_ngram_jaccard, op3_packing, op4_chat_format, op5_decontamination, op6_token_counts, op7_substring_dedup, op8_toxicity, op9_warc, op10_language_id, op11_bpe_codec, op12_periodic_runs, op13_token_alignment

QUERIES = {
    "op1_ann": op1_ann.op1_ann,
    "op2_ngram_jaccard": op2_ngram_jaccard.op2_ngram_jaccard,
    "op3_packing": op3_packing.op3_packing,
    "op4_chat_format": op4_chat_format.op4_chat_format,
    "op5_decontamination": op5_decontamination.op5_decontamination,
    "op6_token_counts": op6_token_counts.op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup.op7_substring_dedup,
    "op8_toxicity": op8_toxicity.op8_toxicity,
    "op9_warc": op9_warc.op9_warc,
    "op10_language_id": op10_language_id.op10_language_id,
    "op11_bpe_codec": op11_bpe_codec.op11_bpe_codec,
    "op12_periodic_runs": op12_periodic_runs.op12_periodic_runs,
    "op13_token_alignment": op13_token_alignment.op13_token_alignment,
}

ORACLES = {
    "op2_ngram_jaccard": op2_ngram_jaccard.ORACLE,
    "op5_decontamination": op5_decontamination.ORACLE,
    "op7_substring_dedup": op7_substring_dedup.ORACLE,
    "op9_warc": op9_warc.ORACLE,
}
