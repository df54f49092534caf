"""Readers, sinks, and adapters from plain tables to the data model."""
