"""Operators: functions from DataFrame to DataFrame.

Operators that learn something from the data come in two halves: ``fit_x``
returns a small dict of parameters from one or a few aggregates, and ``apply_x``
is a lazy projection or filter with those parameters as literals.
"""
