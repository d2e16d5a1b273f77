"""Training-data operators.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds the queries
of its ``catalog`` when it is present.
"""
