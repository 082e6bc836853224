"""Readers that turn files into fact rows."""
