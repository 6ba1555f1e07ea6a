"""Whole jobs built from the operators; these write tables and run loops."""
