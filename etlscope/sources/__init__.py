"""Readers of rules, table definitions, schedules and change lists."""
