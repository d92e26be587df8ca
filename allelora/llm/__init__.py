"""Operators on the text corpus; nothing outside this subpackage imports it."""
