"""The corpus operators' queries and their SQL, by name."""

from . import html_text, licenses, media, mixing, packing, quality, simhash, substring_dedup, tokens, topk

QUERIES = {
    f.__name__: f
    for f in (
        substring_dedup.op1_rlz_substring_dedup,
        quality.op2_pu_quality,
        topk.op3_term_at_a_time_topk,
        html_text.op4_rendered_html,
        tokens.op5_longest_match_tokens,
        licenses.op6_license_signatures,
        simhash.op7_vantage_simhash,
        mixing.op8_hypergeometric_mix,
        packing.op9_length_buckets,
        media.op10_motion_jpeg,
    )
}
SQL = {**substring_dedup.SQL, **topk.SQL, **tokens.SQL}
