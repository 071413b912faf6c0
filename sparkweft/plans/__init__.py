"""Derived tables and whole scans."""
