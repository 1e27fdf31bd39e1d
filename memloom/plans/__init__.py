"""Registered queries, a module for each family of operators."""

import importlib

FAMILIES = ("scoring", "retrieval", "metrics", "rollouts", "sft", "curation", "instances", "memory", "chunking", "io")


def load() -> None:
    for name in FAMILIES:
        importlib.import_module(f"memloom.plans.{name}_queries")
