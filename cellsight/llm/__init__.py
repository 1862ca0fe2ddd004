"""Operators for training-data pipelines: deduplication, scoring, mixing, token counts, decontamination and archives."""
