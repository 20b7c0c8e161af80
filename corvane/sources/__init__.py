"""Adapters that make corpus relations from tables and source trees."""
