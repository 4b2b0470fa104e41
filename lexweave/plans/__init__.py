"""Registered queries: each pairs a job with the SQL that must give the same rows."""
