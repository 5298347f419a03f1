"""Local histogram equalization of three-dimensional point clouds, on Spark."""
