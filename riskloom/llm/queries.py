"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import langid, lzprint, mixing, piece, quality, sepscan, simhash, topk, urlfilter, warc


def queries() -> dict:
    import corpus_pipeline

    ops = (mixing.op1_mix_sources, warc.op2_warc_salvage, quality.op3_quality_classifier, topk.op4_exact_top_k, urlfilter.op5_url_filters, simhash.op6_simhash_near_dedup)
    ops += (lzprint.op7_phrase_fingerprints, sepscan.op8_separator_scan, piece.op9_sentencepiece, langid.op10_language_id)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {"op1_mix_sources": mixing.OP1_SQL, "op4_exact_top_k": topk.OP4_SQL, "op5_url_filters": urlfilter.OP5_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
