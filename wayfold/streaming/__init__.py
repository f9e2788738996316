"""Filters over unbounded streams of fixes."""
