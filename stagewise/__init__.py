"""stagewise: a Spark-first analytics engine for catalogs of recorded performances."""
