"""Readers for trial logs and task inventories, and committed writers."""
