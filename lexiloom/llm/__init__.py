"""Operators of a training-data pipeline. Nothing else in lexiloom imports this subpackage."""
