"""Column expressions over versioned keys and entries."""
