"""Readers: file listings, file heads and EXIF."""
