"""Operators on score vectors, records and labelled rows."""
