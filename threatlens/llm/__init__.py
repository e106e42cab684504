"""Operators of a training-corpus pipeline; nothing else in the package imports them."""
