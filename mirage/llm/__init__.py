"""Operators for training-data pipelines: licences, quality, mixing, packing,
chat formatting, substring and document deduplication, token files, vectors."""
