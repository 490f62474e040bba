"""Operators of a training-data pipeline; nothing else in quire imports them."""
