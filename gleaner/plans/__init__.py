"""End-to-end searches composed from the operators."""
