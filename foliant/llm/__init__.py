"""Operators for preparing training data from document collections. Nothing outside this subpackage imports it."""
