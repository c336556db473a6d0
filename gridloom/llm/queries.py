"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import bpe, collocations, fim, jaccard, lines, mixing, order_minhash, packing, pii, quality, toxicity, urls, weak_labels

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
    "op4_weak_labels": weak_labels.op4_weak_labels,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_mixing": mixing.op6_mixing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_pii": pii.op8_pii,
    "op9_urls": urls.op9_urls,
    "op10_order_minhash": order_minhash.op10_order_minhash,
    "op11_collocations": collocations.op11_collocations,
    "op12_fim": fim.op12_fim,
    "op13_bpe": bpe.op13_bpe,
}

ORACLES = {"op2_line_dedup": lines.ORACLE_OP2, "op9_urls": urls.ORACLE_OP9, "op11_collocations": collocations.ORACLE_OP11, "op12_fim": fim.ORACLE_OP12}
