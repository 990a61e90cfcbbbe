"""The daily aggregation fed by arriving hours instead of a finished table."""
