"""JoinScout: join discovery and query-by-example over data lakes, as lazy Spark plans."""
