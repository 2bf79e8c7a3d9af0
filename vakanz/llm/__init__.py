"""Operators of a training-data pipeline; ``queries`` registers one query per operator."""
