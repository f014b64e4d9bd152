"""Declared schema (DDL) of the table that is read."""

from __future__ import annotations

PAGES = "page_id BIGINT, url STRING, html STRING"
