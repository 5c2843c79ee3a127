"""Operators over text corpora: cleaning, deduplication, decontamination, scoring, and mixing."""
