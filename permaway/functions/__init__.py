"""Column -> Column functions: geodesy, interpolation, numbers and text."""
