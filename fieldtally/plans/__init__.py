"""Composed plans: cleaners, the person table, the person-month layers."""
