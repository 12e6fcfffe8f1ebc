"""Column functions: text cleaning, numeric comparison, time and frames."""
