"""Readers, generators and writers for edges, baskets and text."""
