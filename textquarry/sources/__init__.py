"""Readers that produce corpus tables and writers that publish them."""
