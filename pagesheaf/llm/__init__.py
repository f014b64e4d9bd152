"""Operators of a training-data pipeline: counting, de-duplication, classification, search, mixing and packing."""
