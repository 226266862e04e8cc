"""Structured Streaming form of the upload flow."""
