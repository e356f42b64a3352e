"""Registered queries composed from the operators, each with its SQL oracle."""
