"""Operators for building training data; nothing else in the library depends on this subpackage."""
