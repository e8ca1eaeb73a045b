"""Column expressions: every function takes and returns ``pyspark.sql.Column``."""
