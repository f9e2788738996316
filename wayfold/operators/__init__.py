"""Operators on DataFrames: network, map matching, motion, learning, filters."""
