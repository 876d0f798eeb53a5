"""Multi-step plans, queries and their SQL."""
