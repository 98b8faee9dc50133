"""Declarative graph queries: document, validation, plan cache, execution."""
