"""Sinks: lines of records, framed output, table loads and reports."""
