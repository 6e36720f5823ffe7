"""chartloom: Spark-first operators for evidence records (charts, graphs, text, identity)."""
