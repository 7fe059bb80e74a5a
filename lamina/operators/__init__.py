"""Relational operators over versioned rows: batches, merges, snapshots, run metadata."""
