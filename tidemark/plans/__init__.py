"""Whole questions put together from the operators: a panel from the order tables, and one query per operator."""
