"""Training-data operators: dedup, decontamination, classifiers, tokenizers, search.

Nothing outside this subpackage imports it. Each module holds one operator with
a general interface plus the thin query that applies it to the test tables.
"""
