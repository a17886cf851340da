"""Tideframe."""
