"""webloom: web-content analytics expressed as Spark DataFrame plans."""
