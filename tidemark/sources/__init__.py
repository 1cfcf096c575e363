"""Sources: delivered files as DataFrames of text with lineage."""
