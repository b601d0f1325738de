"""The package's queries and their SQL."""

from tallystone.llm import alignment, decontaminate, jaccard, ledger, negatives, packing, pieces, quality, sharding, substrings, tokenfile, urls, warc

QUERIES = {
    "op1_suffix_dedup": substrings.query,
    "op4_secrets": ledger.query,
    "op5_quality": quality.query,
    "op2_packing": packing.query,
    "op3_token_files": tokenfile.query,
    "op6_jaccard_join": jaccard.query,
    "op7_decontamination": decontaminate.query,
    "op8_warc": warc.query,
    "op9_sharding": sharding.query,
    "op10_url_filters": urls.query,
    "op11_alignment": alignment.query,
    "op12_hard_negatives": negatives.query,
    "op13_sentencepiece": pieces.query,
}
ORACLES = {
    "op7_decontamination": decontaminate.SQL,
    "op8_warc": warc.SQL,
    "op10_url_filters": urls.SQL,
    "op12_hard_negatives": negatives.SQL,
}
