"""Training-data operators: archives, fingerprints, near and exact duplicates, packing, tokenizing, classifiers.

Nothing else in the library imports this subpackage. Each module is one operator with its own
general interface; ``queries`` binds them to the tables and to the result columns asked for.
"""
