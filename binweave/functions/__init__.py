"""Column functions: binning, guarded logarithms and display text."""
