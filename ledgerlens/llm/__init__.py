"""Operators of a training-data pipeline. Nothing outside this folder and the registry imports them."""
