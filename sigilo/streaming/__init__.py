"""Subpackage streaming of sigilo."""
