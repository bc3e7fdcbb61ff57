"""Training-data operators: ten components of a text pipeline at corpus scale."""
