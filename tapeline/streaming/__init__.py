"""Structured Streaming forms of the event operators; each has a batch form in the plans that gives the same rows."""
