"""Subpackage plans of sigilo."""
