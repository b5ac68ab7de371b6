"""The opN_ queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from corpusloom.llm import bpe, decontaminate, html_extract, line_dedup, ngram_join, packing, prefix_trie, quality_model, quality_rules, secrets, snapshot_diff, toxicity, warc

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_bpe": bpe.query,
    "op3_secrets": secrets.query,
    "op4_toxicity": toxicity.query,
    "op5_decontaminate": decontaminate.query,
    "op6_quality_model": quality_model.query,
    "op7_packing": packing.query,
    "op8_warc": warc.query,
    "op9_quality_rules": quality_rules.query,
    "op10_ngram_join": ngram_join.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_snapshot_diff": snapshot_diff.query,
    "op13_html_extract": html_extract.query,
}
ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE, "op8_warc": warc.ORACLE, "op10_ngram_join": ngram_join.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE, "op12_snapshot_diff": snapshot_diff.ORACLE,
}
