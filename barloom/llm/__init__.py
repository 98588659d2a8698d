"""Training-data operators: each module holds one operator on DataFrames of texts.

Nothing outside this subpackage imports it; ``queries.py`` lists its queries.
"""
