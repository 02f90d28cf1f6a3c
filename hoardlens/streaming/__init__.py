"""Figures that follow a folder of manifests as it grows."""
