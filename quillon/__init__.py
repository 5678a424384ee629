"""Rule-based message analytics and training-data operators on Spark."""
