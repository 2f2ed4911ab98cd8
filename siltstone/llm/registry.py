"""Query names of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from siltstone.llm import bpe, collocations, fingerprint, language, neardup, negatives, packing, quality, secrets, sharding, topk, toxicity, warc

QUERIES = {
    "op1_ecoc_language": language.op1,
    "op2_exact_fingerprints": fingerprint.op2,
    "op3_attention_quality": quality.op3,
    "op4_minimax_shards": sharding.op4,
    "op5_bpe_transducer": bpe.op5,
    "op6_exact_complement_packing": packing.op6,
    "op7_warc_salvage": warc.op7,
    "op8_icws_neardup": neardup.op8,
    "op9_pivot_topk": topk.op9,
    "op10_secret_ledger": secrets.op10,
    "op11_kronecker_negatives": negatives.op11,
    "op12_kneser_ney_toxicity": toxicity.op12,
    "op13_era_collocations": collocations.op13,
}

ORACLE = {
    "op7_warc_salvage": warc.ORACLE,
    "op9_pivot_topk": topk.ORACLE,
    "op10_secret_ledger": secrets.ORACLE,
    "op11_kronecker_negatives": negatives.ORACLE,
    "op13_era_collocations": collocations.ORACLE,
}
