"""DataFrame -> DataFrame operators over all series at once."""
