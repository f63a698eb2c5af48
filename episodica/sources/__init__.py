"""Readers and writers: catalog listings, step stores, task files and archives."""
