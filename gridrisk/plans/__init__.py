"""Chains of operators: the training table, day scoring, verification and the read queries."""
