"""User-level jobs (J1-J12): compositions of operators for all series at once."""
