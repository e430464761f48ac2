"""kinfolk: similarity, provenance and evidence analytics as PySpark DataFrames."""
