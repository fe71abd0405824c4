"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from . import collocations, decontaminate, jaccard, manifest, mixing, secret_scan, sharding, substrings, surrogates, tokens, topk, toxicity, url_filter

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_sharding": sharding.op2_sharding,
    "op3_topk": topk.op3_topk,
    "op4_substrings": substrings.op4_substrings,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_surrogates": surrogates.op6_surrogates,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_mixing": mixing.op8_mixing,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_tokens": tokens.op10_tokens,
    "op11_collocations": collocations.op11_collocations,
    "op12_manifest": manifest.op12_manifest,
    "op13_url_filter": url_filter.op13_url_filter,
}
ORACLES = {
    "op3_topk": topk.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op11_collocations": collocations.ORACLE,
    "op12_manifest": manifest.ORACLE,
    "op13_url_filter": url_filter.ORACLE,
}
