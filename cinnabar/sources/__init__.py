"""Catalogs and scans."""
