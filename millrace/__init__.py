"""Keyed, event-time stream analytics and training-data operators on PySpark."""
