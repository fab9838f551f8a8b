"""Queries, includes, change sets, diffs, sessions, attachments and constraints."""
