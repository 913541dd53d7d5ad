"""skylode: a Spark-first search and analytics engine."""
