"""Readers, writers, schemas and configuration."""
