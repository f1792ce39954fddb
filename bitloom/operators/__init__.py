"""Operators layer of the bitloom engine."""
