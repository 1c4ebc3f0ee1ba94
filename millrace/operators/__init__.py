"""Screening operators over text segments."""
