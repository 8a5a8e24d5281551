"""Writers and text forms."""
