"""Readers and writers: text, unit stores, token stores, logs, incremental builds, reports."""
