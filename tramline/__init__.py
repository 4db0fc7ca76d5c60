"""tramline: transit-delay analytics as Spark DataFrame operators."""
