"""Spark-native analytics over spectra, peak lists and descriptor tables."""
