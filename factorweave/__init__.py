"""Cross-sectional factor research and data-processing operators on Spark."""
