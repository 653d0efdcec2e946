"""Column expressions: text patterns, names, numbers, answers, paths."""
