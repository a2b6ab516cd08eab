"""Column functions: clocks, ids and paths, content."""
