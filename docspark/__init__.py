"""Domain classification of large text collections as Spark jobs."""
