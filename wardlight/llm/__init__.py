"""Operators for large-scale training-data pipelines. Nothing else in wardlight imports this subpackage."""
