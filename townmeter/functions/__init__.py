"""Column functions: geography, downscaling, scores, labels."""
