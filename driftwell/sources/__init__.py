"""Readers, writers and pluggable external sources."""
