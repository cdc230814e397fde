"""Readers and writers: configuration, feeds, pages, table snapshots, exports."""
