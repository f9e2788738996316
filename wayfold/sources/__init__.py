"""Readers and writers: traces, configurations, results, road networks."""
