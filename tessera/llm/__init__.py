"""Training-data operators: each module holds one operator with its own general interface.

Nothing outside this subpackage imports it; ``queries`` holds the registered queries and their SQL.
"""
