"""Operators for language-model training corpora: deduplication, filters, decontamination, fingerprints and packing."""
