"""Column expressions: durations, calendar arithmetic and text rules."""
