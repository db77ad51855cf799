"""Training-data operators: dedup, decontamination, PII, quality, packing, chat.

Nothing outside this package imports it; ``queries.py`` holds the registered
queries and their oracle SQL.
"""
