"""Operators for preparing training text and vectors; each module holds one method."""
