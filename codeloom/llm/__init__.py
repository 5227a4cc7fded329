"""Operators for preparing training text at corpus scale. Nothing else in the library depends on this subpackage."""
