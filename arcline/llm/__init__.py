"""Operators for preparing training text at scale, each in a module of its own.

Nothing outside this folder imports it.  ``queries`` in :mod:`arcline.llm.registry` lists the queries.
"""
