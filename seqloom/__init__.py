"""Sequence similarity, clustering and text preparation on Spark."""
