"""Spark jobs for the data work around language-model agents that keep a memory."""
