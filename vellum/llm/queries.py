"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import exact_dedup, media, mixing, ngram_join, packing, quality, sharding, substring_dedup, token_counts, warc

QUERIES = {
    "op1_media": media.op1_media,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op2_ngram_links": ngram_join.op2_ngram_links,
    "op3_mix": mixing.op3_mix,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_quality": quality.op5_quality,
    "op6_shard": sharding.op6_shard,
    "op7_warc": warc.op7_warc,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_pack": packing.op9_pack,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
SQL = exact_dedup.SQL | mixing.SQL | ngram_join.SQL | substring_dedup.SQL | warc.SQL
