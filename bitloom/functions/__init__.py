"""Functions layer of the bitloom engine."""
