"""Structured streams of job events."""
