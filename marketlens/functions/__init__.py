"""Column functions: text and keys (text), prices and money (money), comparisons (compare), labels and rules (rules)."""
