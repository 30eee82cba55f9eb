"""Operators for preparing training corpora.

Nothing outside this subpackage imports it; ``registry`` lists its queries and their SQL.
"""
