"""Property-graph jobs on Spark: views, patterns, entity linking and graph algebra over node and edge tables."""
