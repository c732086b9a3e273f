"""Scalar expressions over sizes, modes, paths, durations and options."""
