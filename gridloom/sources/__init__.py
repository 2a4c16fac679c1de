"""Readers: delimited text and Office Open XML packages."""
