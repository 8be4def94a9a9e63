"""marlspar: a small SQL dialect and data-processing engine on PySpark."""
