"""Matrix operators on DataFrames."""
