"""The registered queries of this subpackage and, where SQL expresses them, their DuckDB SQL."""

from . import decontam, jaccard, licenses, line_dedup, mixing, quality, sharding, token_counts, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_sharding": sharding.op2_sharding,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_mix": mixing.op4_mix,
    "op5_warc": warc.op5_warc,
    "op6_jaccard_join": jaccard.op6_jaccard_join,
    "op7_quality": quality.op7_quality,
    "op8_decontaminate": decontam.op8_decontaminate,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_licenses": licenses.op10_licenses,
}

ORACLE_SQL = {
    "op1_url_filter": url_filter.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op4_mix": mixing.SQL,
    "op5_warc": warc.SQL,
    "op6_jaccard_join": jaccard.SQL,
    "op7_quality": quality.SQL,
    "op8_decontaminate": decontam.SQL,
}
