"""Neighbour joins, clustering, equalization and comparison of point clouds."""
