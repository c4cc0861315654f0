"""orrery: a Spark-first engine for filing metadata, study statistics and training-data corpora."""
