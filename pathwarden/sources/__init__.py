"""Readers and writers of the file formats that data comes in."""
