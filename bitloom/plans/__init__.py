"""Plans layer of the bitloom engine."""
