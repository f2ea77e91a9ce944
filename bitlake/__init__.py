"""bitlake: bit-level, spatial and text operators for PySpark DataFrames."""
