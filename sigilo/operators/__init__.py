"""Subpackage operators of sigilo."""
