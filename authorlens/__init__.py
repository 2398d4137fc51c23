"""Code-authorship analytics as Spark DataFrame operators."""
