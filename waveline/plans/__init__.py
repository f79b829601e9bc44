"""The complete analyses, composed from the operators."""
