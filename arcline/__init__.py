"""arcline: shot-quality analytics as Spark DataFrame operators and batch plans."""
