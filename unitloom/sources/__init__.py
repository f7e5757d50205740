"""Readers and writers: source files, fact records and tables, events, artifacts."""
