"""The versioned table: manifest, flush, compaction and reads over log and runs."""
