"""Operators of a training-data pipeline; nothing outside of this folder imports it."""
