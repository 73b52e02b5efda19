"""Column functions: text normalisation, labels, ranked alternatives, formats."""
