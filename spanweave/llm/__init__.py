"""Training-data operators: ten text operators that nothing else in the library imports."""
