"""Spatial analytics over bags of low-dimensional points, as DataFrame plans."""
