"""Queries of the training-data operators; none of them has SQL, as SQL cannot express parsing, decoding, searching or ranking of this kind."""

from __future__ import annotations

from factloom.llm import docpairs, encoding, languages, leakage, licenses, parseability, provenance, reading, shared_spans

QUERIES = {
    "p1_found": parseability.found,
    "p1_reasons": parseability.reasons,
    "p1_rates": parseability.rates,
    "p3_found": languages.found,
    "p3_shares": languages.language_shares,
    "p4_found": provenance.found,
    "p4_signs": provenance.flagged,
    "p5_found": docpairs.found,
    "p5_pairs": docpairs.pairs,
    "p6_found": licenses.licenses,
    "p6_terms": licenses.terms,
    "p6_repositories": licenses.repositories,
    "p7_found": shared_spans.found,
    "p7_shares": shared_spans.shares,
    "p7_links": shared_spans.links,
    "p8_ids": encoding.ids,
    "p9_found": leakage.found,
    "p9_spans": leakage.leaks,
    "p10_found": reading.levels,
}
ORACLE: dict[str, str] = {}
