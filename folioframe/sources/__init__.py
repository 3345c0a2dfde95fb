"""Where catalogues come from: Parquet folders, SQLite files, and file listings."""
