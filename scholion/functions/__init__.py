"""Column expressions: each takes and returns Columns, so everything stays inside generated code."""
