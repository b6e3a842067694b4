"""Registered queries of this package: name -> callable(spark, sf_dir), and SQL where it can say the same."""

from fluxweave.llm import bpe, chat, clusters, collocations, decontaminate, html_text, mixing, neardup, neardup_vectors, quality, spotsigs, substrings, warc

LLM_QUERIES = {
    "op1_spotsigs": spotsigs.op1_spotsigs,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_minhash_near_dedup": neardup.op3_minhash_near_dedup,
    "op4_embedding_near_dedup": neardup_vectors.op4_embedding_near_dedup,
    "op5_chat_format": chat.op5_chat_format,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_substring_dedup": substrings.op7_substring_dedup,
    "op8_html_extraction": html_text.op8_html_extraction,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_warc_derivatives": warc.op10_warc_derivatives,
    "op11_ptolemaic_clusters": clusters.op11_ptolemaic_clusters,
    "op12_decontaminate": decontaminate.op12_decontaminate,
    "op13_collocations": collocations.op13_collocations,
}
LLM_CHECKS: dict[str, str] = {
    "op4_embedding_near_dedup": neardup_vectors.OP4_SQL,
    "op5_chat_format": chat.OP5_SQL,
    "op7_substring_dedup": substrings.OP7_SQL,
    "op11_ptolemaic_clusters": clusters.OP11_SQL,
    "op12_decontaminate": decontaminate.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
