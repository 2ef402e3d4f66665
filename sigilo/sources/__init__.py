"""Subpackage sources of sigilo."""
