"""Sinks: GeoTIFF files and an upsertable cube."""
