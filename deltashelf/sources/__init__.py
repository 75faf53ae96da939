"""Readers of captured catalogue responses."""
