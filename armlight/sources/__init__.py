"""Scans, sinks and the tables that policy replays read."""
