"""Shared parts of plans: the domain views over the stored tables."""
