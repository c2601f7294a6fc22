"""Whole jobs and the layouts and definitions they take."""
