"""Operators of a training-data pipeline, each ``DataFrame(s) + parameters -> DataFrame``."""
