"""Relational, raster, graph and data-quality operators."""
