"""Training-data operators: thirteen jobs on documents, conversations and vectors that run as Spark stages.

Nothing else in the library imports this subpackage, and it imports nothing from the rest of
the library. Every operator takes DataFrames and returns DataFrames; Python runs only inside
Arrow batches.
"""
