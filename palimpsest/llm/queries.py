"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import langid, lines, media, mixing, ngram_join, nn_descent, packing, quality, suffix, warc

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_quality": quality.op2_quality,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_warc": warc.op4_warc,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_language": langid.op6_language,
    "op7_suffix_dedup": suffix.op7_suffix_dedup,
    "op8_pack_sequences": packing.op8_pack_sequences,
    "op9_embedding_dedup": nn_descent.op9_embedding_dedup,
    "op10_media": media.op10_media,
}

ORACLE_SQL = {
    "op1_line_dedup": lines.ORACLE,
    "op3_mix_sources": mixing.ORACLE,
    "op4_warc": warc.ORACLE,
}
