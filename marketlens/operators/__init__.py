"""The analytic operators, by family; each module has a list OPERATORS."""
