"""Reports and multi-step runs built from the operators."""
