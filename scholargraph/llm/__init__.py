"""Operators of a training-data pipeline over large text tables.

Nothing outside this subpackage imports it. ``queries`` holds the named
queries; every operator lives in a module of its own.
"""
