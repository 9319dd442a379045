"""Monitoring of live scores, in batch and as a stream."""
