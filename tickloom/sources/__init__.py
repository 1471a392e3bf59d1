"""Where bars and securities come from: vendors' payloads, stored tables and the sample tables."""
