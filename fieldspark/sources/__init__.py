"""Scans: files, archives, spreadsheets and page tables."""
