"""Readers with explicit schemas and column contracts."""
