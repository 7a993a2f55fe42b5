"""Column functions: NULL rules, calendar labels, scalar maths, small numerics."""
