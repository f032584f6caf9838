"""Folio: classification records, their history and their evaluation as Spark jobs."""
