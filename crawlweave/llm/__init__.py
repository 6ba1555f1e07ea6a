"""Operators for preparing training corpora, one module each.

Nothing else in the library imports this subpackage. ``queries`` registers one
query per operator; ``corpus_pipeline.py`` beside the package chains five.
"""
