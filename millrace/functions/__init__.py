"""Column expressions: text, numbers, number words, dates and formats."""
