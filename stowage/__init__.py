"""stowage: dependency-graph and content-addressed-store analytics on Spark."""
