"""Training-data operators: dedup, decontamination, scoring, filtering, mixing and sharding.

Nothing outside this subpackage imports it.
"""
