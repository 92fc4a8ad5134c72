"""Operators for preparing training data at scale.

Nothing outside this subpackage (and the pipeline built on it) imports it.  Each module holds one
operator with its general interface; ``registry`` holds the thin contract queries and their SQL.
"""
