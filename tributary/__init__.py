"""A Spark-first analytics library: batch queries, stream windows, partition strategies, sketches."""
