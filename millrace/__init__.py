"""millrace: a Spark-first engine for building, curating and evaluating text and optimisation datasets."""
