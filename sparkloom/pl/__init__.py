"""Procedures, functions and triggers."""
