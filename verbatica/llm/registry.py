"""Queries of this package by name, each with its SQL or None."""

from __future__ import annotations

from . import bpe, centroids, decontamination, fill_in_middle, fingerprints, html_extraction, language, licenses, minhash_dedup, quality, sharding, suffix_dedup, url_filter

QUERIES = {
    **language.QUERIES,
    **licenses.QUERIES,
    **url_filter.QUERIES,
    **fingerprints.QUERIES,
    **quality.QUERIES,
    **suffix_dedup.QUERIES,
    **sharding.QUERIES,
    **bpe.QUERIES,
    **decontamination.QUERIES,
    **minhash_dedup.QUERIES,
    **centroids.QUERIES,
    **fill_in_middle.QUERIES,
    **html_extraction.QUERIES,
}
