"""Where tables live: a catalog document and versioned Parquet folders, and the key-value log."""
