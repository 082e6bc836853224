"""Training-data operators. Optional: nothing else in the package imports this subpackage."""
