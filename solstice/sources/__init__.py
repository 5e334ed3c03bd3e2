"""Sources: landed-file scans (A1-A5, A9, A10), sinks (A8) and the mapping of
the benchmark tables onto daily series (``tables``)."""
