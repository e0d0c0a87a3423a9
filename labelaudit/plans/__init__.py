"""Whole jobs: several operators in one run."""
