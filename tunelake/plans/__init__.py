"""Derived inputs and the registered queries."""
