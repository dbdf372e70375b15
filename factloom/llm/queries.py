"""The queries of this subpackage and, where SQL can express one, its SQL."""

from factloom.llm import media, mixing, ngram_join, packing, pii, quality, records, tokens, toxicity, vptree

QUERIES = {
    "op1_media_columns": media.query,
    "op2_ngram_jaccard_join": ngram_join.query,
    "op3_crf_quality": quality.query,
    "op4_bootstrapped_pii": pii.query,
    "op5_cost_balanced_packing": packing.query,
    "op6_binary_records": records.query,
    "op7_noisy_channel_toxicity": toxicity.query,
    "op8_vantage_point_neighbours": vptree.query,
    "op9_token_counts": tokens.query,
    "op10_mixing": mixing.query,
}
SQL = {"op2_ngram_jaccard_join": ngram_join.SQL, "op8_vantage_point_neighbours": vptree.SQL, "op10_mixing": mixing.SQL}
