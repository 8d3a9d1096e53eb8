"""Operators for preparing training text; see ``queries`` for the ready ones and each module for its method."""
