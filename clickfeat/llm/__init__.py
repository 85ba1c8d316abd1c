"""Operators for training-data pipelines: clean, deduplicate, score, format and pack text.

Each module holds one operator with a general interface; ``queries`` registers one query per operator.
"""
