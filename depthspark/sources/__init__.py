"""Readers for raw depth messages and stored tables, and writers for feeds and logs."""
