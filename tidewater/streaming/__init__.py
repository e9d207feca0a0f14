"""Change feeds as streams, and syncs that follow a source."""
