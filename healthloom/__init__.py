"""Code health as a relational workload on Spark."""
