"""Operators of a training-data pipeline; nothing else in loomlake imports them."""
