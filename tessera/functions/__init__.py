"""Column functions: text normalisation and similarities."""
