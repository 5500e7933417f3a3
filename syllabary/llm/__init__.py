"""Operators of a training-corpus pipeline. Nothing else in the library imports this subpackage."""
