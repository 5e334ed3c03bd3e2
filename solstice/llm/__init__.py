"""Training-data operators: quality, dedup, extraction, filters, PII, search, BPE.

Nothing else in the library imports this subpackage.  Each operator lives in
its own module with a general interface; ``queries.py`` holds the thin
``opN_<name>`` queries and ``oracles.py`` their DuckDB twins.
"""
