"""The training-data queries: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from threatscan.llm import chat, decontaminate, dedup_lines, fingerprint, html, langid, lm, middle, packing, pii, quality, simhash, trie


def registered() -> dict:
    out: dict = {}
    for m in (chat, decontaminate, dedup_lines, fingerprint, html, langid, lm, middle, packing, pii, quality, simhash, trie):
        out |= m.QUERIES
    return out
