"""Spark-native inference and analytics over photometry, spectra and model grids."""
