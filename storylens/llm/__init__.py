"""Operators of a training-data pipeline: one module per operator, registered queries in ``queries``."""
