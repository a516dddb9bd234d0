"""hydrospark: water-quality monitoring tables and training-data operators on Spark."""
