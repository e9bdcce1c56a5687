"""Operators for large-scale training-data preparation.

Nothing outside this folder imports it; ``queries`` holds what the entry
module registers.
"""
