"""Source-security analytics and training-data operators on Spark."""
