"""DataFrame operators: joins, windows, grid and spatial work, sampling and statistics."""
