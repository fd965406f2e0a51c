"""loomtext: memory and text analytics as Spark DataFrame operators."""
