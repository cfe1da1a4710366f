"""Operators for preparing language-model training data at corpus scale.

Self-contained: nothing else in the library imports this subpackage.
"""
