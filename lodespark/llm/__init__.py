"""Operators of a training-corpus pipeline. Nothing else in the package imports this subpackage."""
