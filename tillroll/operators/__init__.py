"""The operators, one module per subject."""
