"""Column functions: no shuffle, no UDF, all inside generated code."""
