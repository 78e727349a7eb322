"""Readers and writers: entry tables and multi-line text logs."""
