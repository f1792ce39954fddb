"""Sources layer of the bitloom engine."""
