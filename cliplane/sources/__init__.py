"""Readers and the adapters that map stored tables to logical inputs."""
