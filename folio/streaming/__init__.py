"""An extension: records from a folder that files are dropped into."""
