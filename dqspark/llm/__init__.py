"""Training-data operators: ten corpus operators and their driver queries.

Nothing else in the library imports this subpackage; it may import the general
helpers (table access, session defaults).
"""
