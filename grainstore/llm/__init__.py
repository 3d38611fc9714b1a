"""Operators for preparing text, chat and source collections; nothing else in the library imports this subpackage."""
