"""Icon-sheet analytics as Spark DataFrame operators."""
