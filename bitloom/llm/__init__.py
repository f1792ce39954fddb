"""Training-data operators. Nothing else in bitloom imports this subpackage."""
