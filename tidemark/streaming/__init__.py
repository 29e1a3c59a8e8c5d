"""Structured streams over timed text."""
