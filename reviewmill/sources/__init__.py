"""Inputs and outputs: feedback files, table snapshots, test-table adapters."""
