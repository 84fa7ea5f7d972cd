"""Column functions: numbers, places and text."""
