"""Whole reports built from the operators, and the registered queries."""
