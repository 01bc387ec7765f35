"""Readers and writers of lexicons, lists, logs, ledgers and reports."""
