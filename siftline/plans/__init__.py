"""Driver-side plans: runs, slots and ingest."""
