"""Operators for preparing large text corpora for model training.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
