"""Operators that prepare text collections for training. Nothing else in the package imports this one."""
