"""Runnable jobs over the library; each has a command line and a config file."""
