"""Operators over call graphs."""
