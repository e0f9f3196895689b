"""Operators of a large-scale training-data pipeline (DataFrame in, DataFrame out).

Nothing outside this folder imports it; its queries are registered by the
driver entry only when the folder is present.
"""
