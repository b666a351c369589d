"""Training-data operators: dedup, archives, classifiers, mixing, packing, retrieval, formatting, rules.

Each module holds one operator with a general interface; ``queries`` registers the
catalogue queries and their SQL twins.  Nothing outside this folder imports it.
"""
