"""Operators for preparing text corpora at scale.

Each module is one operator with a general interface; ``queries.py`` holds the
thin ``opN_<name>`` queries over the standard tables and ``sql.py`` their SQL.
Nothing outside this subpackage imports it.
"""
