"""lonja: price analytics as Spark DataFrame operators."""
