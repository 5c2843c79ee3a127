"""Readers, writers, and adapters that shape other tables into a panel study."""
