"""Operators for large text and record collections; nothing else in the library imports this subpackage."""
