"""Structured Streaming counterparts of the time-dependent operators; each has a batch form that gives the same rows."""
