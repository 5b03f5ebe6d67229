"""Scans, sinks and derived inputs."""
