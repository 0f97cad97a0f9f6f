"""Readers and writers: CSV tables, landed JSON pages, GeoJSON."""
