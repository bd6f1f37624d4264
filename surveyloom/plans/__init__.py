"""The six analyses, composed from the operators."""
