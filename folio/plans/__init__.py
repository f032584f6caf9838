"""Fixture views and the queries of the driver contract."""
