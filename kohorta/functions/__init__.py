"""Column-level building blocks: column rules, scalar functions, probability formulas."""
