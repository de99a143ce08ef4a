"""textloom: Spark-first analytics for multilingual text corpora and the operational tables around them."""
