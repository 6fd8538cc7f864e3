"""Media-catalogue and edit-planning analytics on Spark DataFrames."""
