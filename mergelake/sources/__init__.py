"""Scans and exports."""
