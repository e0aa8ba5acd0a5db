"""Training-data operators: ten corpus operators and the queries built on them.

Nothing outside this subpackage imports it.
"""
