"""Readers: tables, landed pages and payloads."""
