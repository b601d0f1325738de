"""Bindings of the shared tables to domain tables, query catalogue and oracles."""
