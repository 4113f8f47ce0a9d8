"""Training-data operators.

Each module holds one operator with its own interface; ``queries`` registers
the thin ``opN_`` queries over the corpus tables.  Nothing else in the library
imports this subpackage.
"""
