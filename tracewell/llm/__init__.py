"""Operators for building training corpora: ten independent modules and their queries."""
