"""Perceptual fingerprints of images and other 2-D planes, and similarity queries over them, on Spark."""
