"""Operators for preparing training data: each module holds one method, ``queries`` registers them."""
