"""Raster tracking and event analytics as DataFrame-to-DataFrame operators."""
