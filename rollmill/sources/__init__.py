"""Readers, writers and source blending."""
