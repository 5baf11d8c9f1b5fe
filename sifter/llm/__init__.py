"""Operators for preparing large text corpora as language-model training data.

Nothing else in the library imports this subpackage.
"""
