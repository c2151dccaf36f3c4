"""Jobs over ledgers: DataFrames in, DataFrames (with side outputs) out."""
