"""Column-level building blocks: dates, numbers, text, aggregates, ranking."""
