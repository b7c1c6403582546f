"""Operators of a large-scale training-data pipeline, one module each, and their queries (``queries.py``)."""
