"""Readers and writers: tables, caches, artifacts."""
