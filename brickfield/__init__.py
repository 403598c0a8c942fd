"""Voxel analytics expressed as Spark DataFrame plans."""
