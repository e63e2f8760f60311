"""Operators that prepare training text at corpus scale, and their queries."""
