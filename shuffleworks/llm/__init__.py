"""Operators of a training-data pipeline, each by a method of its own. Nothing else in the library imports them."""
