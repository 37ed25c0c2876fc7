"""Scans and sinks, and the views that give the driver tables their business roles."""
