"""Operators for preparing training text.

Nothing else in the library imports this folder. Each operator has a module with
its own interface; ``queries`` applies them to the test tables.
"""
