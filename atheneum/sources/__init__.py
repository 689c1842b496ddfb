"""Readers of folders."""
