"""Jobs: the journal, retries, the runner."""
