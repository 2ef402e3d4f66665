"""Subpackage functions of sigilo."""
