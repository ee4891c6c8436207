"""Batch jobs, reports, and the registered queries with their check SQL."""
