"""Whole plans made of operators, and the queries registered over the test tables."""
