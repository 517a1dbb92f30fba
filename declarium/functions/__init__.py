"""Column expressions: text, dates, numbers and a small linear solver."""
