"""The polled figures and the incremental load as Structured Streaming jobs."""
