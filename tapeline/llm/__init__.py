"""Operators for large text corpora and record matching; nothing outside this subpackage imports it."""
