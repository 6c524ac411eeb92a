"""Training-data operators: ten corpus operators that nothing else in the library imports."""
