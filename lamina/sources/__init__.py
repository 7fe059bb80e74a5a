"""Where versioned rows come from and go to: log segments, sorted runs, binary files."""
