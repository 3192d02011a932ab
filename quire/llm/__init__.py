"""Operators of a training-data pipeline. Nothing else in quire imports this."""
