"""Operators put together: collect, report, process and deduplicate."""
