"""Column builders: no function here triggers a job."""
