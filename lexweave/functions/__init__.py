"""Column expressions; none of them triggers a job."""
