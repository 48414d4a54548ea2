"""Composite jobs and the registered query catalogue."""
