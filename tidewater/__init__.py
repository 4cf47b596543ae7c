"""Water-quality analytics as Spark DataFrame programs."""
