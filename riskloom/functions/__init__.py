"""Column expression builders; nothing in here triggers a job."""
