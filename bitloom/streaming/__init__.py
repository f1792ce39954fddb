"""The funnel over a stream of files."""
