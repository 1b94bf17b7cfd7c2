"""Training-data operators: thirteen corpus operators and the queries that apply them.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it is present.
"""
