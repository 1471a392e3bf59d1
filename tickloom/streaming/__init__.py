"""Streams of bars. The batch engine has no stream of its own; this keeps its store up to date."""
