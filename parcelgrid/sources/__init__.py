"""Readers and writers: GeoJSON, project JSON, DXF text, asset text, regulations."""
