"""Operators of a training-data pipeline, on their own: nothing else in the library uses them."""
