"""Which reports exist, how they are refreshed, and how they are checked."""
